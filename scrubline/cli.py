"""Command line: ``python -m scrubline.cli scan FILE… | clean [-o DIR] [--no-icc] [--no-orientation] FILE… | text [--markdown]``."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import SparkSession, functions as F

from scrubline.functions import sniff
from scrubline.functions.text import TextOptions
from scrubline.operators import findings
from scrubline.operators.sanitize import clean_text, summary
from scrubline.operators.strip import StripOptions
from scrubline.plans.media import clean_media
from scrubline.sources.files import report_lines


def _session() -> SparkSession:
    return SparkSession.builder.appName("scrubline").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def scan(spark: SparkSession, paths: list[str]) -> int:
    """1 if any file has AI markers."""
    reports = findings.scan(spark.read.format("binaryFile").load(paths)).select("path", "report").cache()
    lines = report_lines(findings.explode_findings(reports, ["path"]))
    by_path = {r.path: r.lines for r in lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines")).collect()}
    marked = 0
    for r in reports.select("path", "report.format", "report.parse_error", findings.report_columns(F.col("report"))["has_ai"].alias("has_ai")).collect():
        print(os.path.basename(r.path))
        print(f"  format: {r.format}" + (f"  (parse error: {r.parse_error})" if r.parse_error else ""))
        print("\n".join(f"  {x.line}" for x in by_path.get(r.path, [])) or "  no metadata found")
        marked += r.has_ai
    return int(marked > 0)


def clean(spark: SparkSession, paths: list[str], folder: str | None, options: StripOptions) -> int:
    """1 if any file could not be cleaned."""
    failed = 0
    extension = {f[0]: f[3] for f in sniff.FORMATS}
    for r in clean_media(spark.read.format("binaryFile").load(paths), "content", options).drop("content").toLocalIterator():
        source = r.path.removeprefix("file:")
        base = os.path.splitext(os.path.basename(source))[0]
        if r.status == "UNSUPPORTED":
            print(f"{os.path.basename(source)}: needs re-encoding ({r.outcome.reason})")
            failed += 1
            continue
        target = os.path.join(folder or os.path.dirname(source), f"{base}_clean.{extension[r.format]}")
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as f:
            f.write(r.outcome.data)
        print(f"{os.path.basename(source)} -> {os.path.basename(target)}: {r.status}")
        print("  removed: " + ", ".join(f"{x.location} ({x.bytes} B)" for x in r.outcome.removed))
        failed += r.status != "CLEAN"
    return int(failed > 0)


def lines(source: str) -> str:
    """Line ends as newlines, a final one dropped; other separators are hidden characters and stay."""
    return re.sub("\r\n?", "\n", source).removesuffix("\n")


def text(spark: SparkSession, source: str, markdown: bool) -> int:
    df = spark.createDataFrame([(lines(source),)], "text string")
    r = clean_text(df, options=TextOptions(strip_markdown=markdown)).select("cleaned.text", summary(F.col("cleaned")).alias("summary")).first()
    print(r.text)
    print(r.summary, file=sys.stderr)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="scrubline")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("scan").add_argument("files", nargs="+")
    c = sub.add_parser("clean")
    c.add_argument("-o", dest="folder")
    c.add_argument("--no-icc", action="store_true")
    c.add_argument("--no-orientation", action="store_true")
    c.add_argument("files", nargs="+")
    sub.add_parser("text").add_argument("--markdown", action="store_true")
    a = p.parse_args(argv)
    spark = _session()
    if a.command == "scan":
        return scan(spark, a.files)
    if a.command == "clean":
        return clean(spark, a.files, a.folder, StripOptions(keep_icc=not a.no_icc, keep_orientation=not a.no_orientation))
    return text(spark, sys.stdin.buffer.read().decode(errors="replace"), a.markdown)


if __name__ == "__main__":
    sys.exit(main())
