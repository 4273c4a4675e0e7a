"""File sources, sinks and their naming rules."""

from __future__ import annotations

import io
import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scrubline.functions.names import fresh, others
from scrubline.operators.strip import StripOptions, strip_video

MAX_BYTES, MAX_TEXT_BYTES, WORK_HOURS = 256 << 20, 2 << 20, 24
FREE_RESERVE = 64 << 20
#: Folders that results may be published to, and names that say a generator made the file. Fixed values.
IMAGE_FOLDERS, VIDEO_FOLDERS = ("DCIM", "Pictures"), ("DCIM", "Movies", "Pictures")
GENERATED_NAME = (
    "(?i)(chatgpt|dall[-·_ ]?e|openai|gemini|imagen|nano[-_ ]?banana|firefly|midjourney|mj_|stable[-_ ]?diffusion|sdxl|comfyui|flux|grok|aurora|sora|veo|"
    "kling|hailuo|runway|luma|pika|leonardo|ideogram|copilot|designer|bing|dreamina|jimeng|doubao|seedream|qwen|recraft|krea|upscayl|generated|\\bai[-_ ])"
)


def binary_files(spark: SparkSession, paths: list[str], max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files with content, files beyond the limit without it). The length filter is pushed to the source, so no
    oversized file is read."""
    files = spark.read.format("binaryFile").load(paths)
    large = files.where(F.col("length") > max_bytes).select("path", "modificationTime", "length", F.lit("too_large").alias("error"))
    return files.where(F.col("length") <= max_bytes), large


def heads(files: DataFrame, n: int = 256) -> DataFrame:
    return files.select("path", "length", F.substring("content", 1, n).alias("head"))


def whole_text(content: Column) -> Column:
    """UTF-8 with line ends as newlines, a final one dropped."""
    return F.regexp_replace(F.regexp_replace(F.decode(content, "UTF-8"), "\r\n?", "\n"), "\n\\z", "")


def within_limit(files: DataFrame, max_bytes: int = MAX_TEXT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files up to the limit, the others without content but with an error). files: (content, length, ...). The test is
    on length alone, so a file source reads no content for it."""
    return files.where(F.col("length") <= max_bytes), files.where(F.col("length") > max_bytes).drop("content").withColumn("error", F.lit("too_large"))


def text_files(spark: SparkSession, path: str, max_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """(path, text, error) of whole files up to the limit."""
    small, large = within_limit(spark.read.format("binaryFile").load(path), max_bytes)
    read = small.select("path", whole_text(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    return read.unionAll(large.select("path", F.lit(None).cast("string"), "error"))


def describe(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """path, name, bytes, modified, mime: the manifest (path, mime) may lack any file."""
    base = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    if manifest is None:
        return base.withColumn("mime", F.lit(None).cast("string"))
    return base.join(manifest.select("path", "mime"), "path", "left")


def resolve_gallery(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds gallery_id by uri; null for items from elsewhere."""
    return items.join(catalog.select("uri", "gallery_id"), "uri", "left")


def clean_name(name: Column, extension: Column) -> Column:
    """``<base>_clean.<ext>`` beside the source."""
    base = F.regexp_replace(name, "\\.[^.]*\\z", "")
    return F.concat(base, F.lit("_clean."), extension)


def output_name(name: Column, kind: Column, stamp: Column, number: Column, neutral: Column) -> Column:
    """Neutral ``IMG_<stamp>_<nn>`` / ``VID_…`` if asked for or if the name tells a generator; else the sanitised base
    name with ``_clean``."""
    plain = F.concat(F.when(kind == "VIDEO", "VID_").otherwise("IMG_"), stamp, F.lit("_"), F.lpad((number % 100).cast("string"), 2, "0"))
    base = F.substring(F.regexp_replace(F.regexp_replace(name, "\\.[^.]*\\z", ""), "[^\\p{L}\\p{N}._ -]", "_"), 1, 80)
    return F.when(neutral | looks_generated(name), plain).otherwise(F.concat(F.when(F.trim(base) == "", "file").otherwise(base), F.lit("_clean")))


def number_collisions(df: DataFrame, name: str, order: str, into: str = "unique_name", salts: int = 64) -> DataFrame:
    """Adds a name made unique by a suffix ``_1``, ``_2``, …, within each of ``salts`` parts of a name in order.

    A name that very many files share is numbered part by part: only counts of parts meet in one task.
    """
    from pyspark.sql import Window

    salt, own, before, n = fresh(df, "salt", "own", "before", "n")
    parts = df.withColumn(salt, F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    upto = Window.partitionBy(name).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(name, salt).agg(F.count("*").alias(own))
    starts = counts.select(F.col(name).alias(n), F.col(salt).alias(own), F.coalesce(F.sum(own).over(upto), F.lit(0)).alias(before))
    numbered = parts.withColumn("_" + n, F.row_number().over(Window.partitionBy(name, salt).orderBy(order)) - 1)
    joined = numbered.join(starts, F.col(name).eqNullSafe(F.col(n)) & (F.col(salt) == F.col(own)))
    at = F.col("_" + n) + F.col(before)
    return joined.select(*others(df, into), F.when(at == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), at.cast("string"))).alias(into))


def looks_generated(name: Column) -> Column:
    return name.rlike(GENERATED_NAME)


def allowed_folder(path: Column, is_video: Column, fallback: str = "Pictures") -> Column:
    """path if its top folder is allowed and it has no parent step, else the fallback."""
    top = F.element_at(F.split(path, "/"), 1)
    ok = F.when(is_video, top.isin(*VIDEO_FOLDERS)).otherwise(top.isin(*IMAGE_FOLDERS)) & ~path.contains("..")
    return F.when(F.coalesce(ok, F.lit(False)), path).otherwise(F.lit(fallback))


def human_size(size: Column, units: tuple[str, ...] = ("KB", "MB", "GB")) -> Column:
    """``512 B``, ``1.5 KB``, …, the last unit for all that is larger; a dash for null or negative sizes."""
    shown = F.when(size.isNull() | (size < 0), "—").when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units, 1):
        step = F.format_string(f"%.1f {unit}", size / float(1024**k))
        shown = shown.when(size < 1024 ** (k + 1), step) if k < len(units) else shown.otherwise(step)
    return shown


def expired(work_files: DataFrame, now: Column, hours: int = WORK_HOURS) -> DataFrame:
    """Work files past their time (path, modified); deleting them is the caller's choice."""
    return work_files.where(F.col("modified") < now - F.expr(f"INTERVAL {hours} HOURS"))


def report_lines(found: DataFrame) -> DataFrame:
    """``[severity] kind @ location — detail`` of each finding."""
    tail = F.coalesce(F.concat(F.lit(" — "), F.col("detail")), F.lit(""))
    return found.withColumn("line", F.concat(F.format_string("[%s] %s @ %s", "severity", "kind", "location"), tail))


def write_videos(files: DataFrame, folder: str, options: StripOptions = StripOptions()) -> DataFrame:
    """Path mode for videos of any size on mounted storage: (path, output, bytes, removed, error). The folder must be one
    that all executors share.

    Outputs of files with one base name are numbered. Each output is written under a temporary name and renamed when complete, so a lost task leaves nothing half done
    under the final name, and a repeated task replaces it with the same bytes.
    """
    schema = pa.schema([("path", pa.string()), ("output", pa.string()), ("bytes", pa.int64()), ("removed", pa.int64()), ("error", pa.string())])

    def one(path: str, name: str, ext: str) -> dict:
        final = os.path.join(folder.removeprefix("file:"), f"{name}{ext}")
        part = f"{final}.{os.getpid()}.part"
        try:
            if os.path.getsize(path.removeprefix("file:")) > shutil.disk_usage(os.path.dirname(final)).free - FREE_RESERVE:
                return {"path": path, "output": None, "bytes": None, "removed": None, "error": "no_space"}
            with open(path.removeprefix("file:"), "rb") as f, open(part, "wb") as o:
                done = strip_video(f, f.seek(0, io.SEEK_END), o.write, options)
            os.replace(part, final)
            return {"path": path, "output": final, "bytes": os.path.getsize(final), "removed": len(done.removed), "error": None}
        except Exception as e:
            if os.path.exists(part):
                os.remove(part)
            return {"path": path, "output": None, "bytes": None, "removed": None, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)], schema=schema)

    last = F.element_at(F.split("path", "/"), -1)
    ext = F.regexp_extract(last, "(?<=[^.])\\.[^.]*\\z", 0)
    named = files.select("path", ext.alias("ext"), F.concat(F.regexp_replace(last, "(?<=[^.])\\.[^.]*\\z", ""), F.lit("_clean"), ext).alias("output"))
    unique = number_collisions(named, "output", "path").select("path", F.col("unique_name"), "ext", "output")
    number = F.regexp_extract(F.substring(F.col("unique_name"), F.length("output") + 1, F.length("unique_name")), "_[0-9]+", 0)
    stem = F.concat(F.substring(F.col("output"), F.lit(1), F.length("output") - F.length("ext")), number)
    return unique.select("path", stem.alias("stem"), "ext").mapInArrow(run, "path string, output string, bytes long, removed long, error string")


def delete_originals(written: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(path, deleted, error): deletes sources on mounted storage, but only those whose path is in ``confirmed`` and whose
    output (of write_videos) is there and not empty. Nothing else in the engine deletes a source.

    A repeated task finds its files gone and says so as deleted.
    """
    schema = pa.schema([("path", pa.string()), ("deleted", pa.bool_()), ("error", pa.string())])

    def one(path: str, output: str) -> dict:
        source = path.removeprefix("file:")
        try:
            if not os.path.getsize(output):
                return {"path": path, "deleted": False, "error": "empty output"}
            if os.path.exists(source):
                os.remove(source)
            return {"path": path, "deleted": True, "error": None}
        except OSError as e:
            return {"path": path, "deleted": False, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)], schema=schema)

    wanted = written.where("output is not null").select("path", "output").join(confirmed.select("path").distinct(), "path", "left_semi")
    return wanted.mapInArrow(run, "path string, deleted boolean, error string")
