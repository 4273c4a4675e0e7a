"""Scan, strip, re-scan, publish: one lineage of columns, the gate is a filter.

No source is ever deleted here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scrubline.functions import sniff
from scrubline.functions.names import fresh, others
from scrubline.operators import findings
from scrubline.operators.strip import StripOptions, strip_content

MIN_PIXELS, MAX_PIXELS = 8_000_000, 120_000_000


def clean_media(df: DataFrame, content: str = "content", options: StripOptions = StripOptions()) -> DataFrame:
    """Adds format, before, outcome, after and status to payloads; columns of these names are replaced, all others stay.

    status: CLEAN (stripped, the re-scan finds nothing that must go), RESIDUAL (something is left), UNSUPPORTED.
    """
    made = ("format", "before", "outcome", "after", "status")
    payload, data = fresh(df, "payload", "data")
    work = df.select(*others(df, *[n for n in made if n != content]), F.col(content).alias(payload))
    work = findings.scan(work.withColumn("format", sniff.detect_format(F.col(payload))), payload, "before")
    work = work.withColumn("outcome", strip_content(F.col(payload), F.col("format"), options))
    work = findings.scan(work.withColumn(data, F.col("outcome.data")), data, "after").drop(data)
    facts = findings.report_columns(F.col("after"))
    clean = facts["is_clean"] if options.keep_icc else facts["is_clean_without_icc"]
    status = F.when(F.col("outcome.status") != "stripped", "UNSUPPORTED").when(clean, "CLEAN").otherwise("RESIDUAL")
    return work.select(*others(df, *made), *made[:4], F.when(F.col("outcome").isNotNull(), status).alias("status"))


def publish_gate(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what may be published, what must not)."""
    ok = F.col("status") == "CLEAN"
    return cleaned.where(ok), cleaned.where(~F.coalesce(ok, F.lit(False)))


def removed_audit(cleaned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, type, location, bytes: one row for each removed block."""
    return cleaned.select(*keys, F.posexplode("outcome.removed").alias("seq", "r")).select(*keys, "seq", "r.type", "r.location", "r.bytes")


def removed_by_reencoding(found: DataFrame, keys: list[str]) -> DataFrame:
    """What a re-encoding would remove: non-informational findings, one a location."""
    return found.where("severity <> 'INFO'").dropDuplicates([*keys, "location"]).select(*keys, "kind", "location")


def chips(found: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Up to k labels a file: informational ones left out, one a label, most severe first."""
    from pyspark.sql import Window

    label = F.when((F.col("kind") == "AI_GENERATOR") | (F.col("kind") == "AI_SOURCE_TYPE"), F.col("detail")).otherwise(F.col("kind"))
    named = found.where("severity <> 'INFO'").withColumn("label", label)
    first = named.groupBy(*keys, "label").agg(F.min("seq").alias("seq"), F.min_by("severity", "seq").alias("severity"))
    rank = F.when(F.col("severity") == "AI", 0).otherwise(1)
    order = Window.partitionBy(*keys).orderBy(rank, "seq", "label")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select(*keys, "n", "label", "severity")


def batch_summary(items: DataFrame) -> DataFrame:
    """Per batch: done, active and with AI markers. items: (batch, status, has_ai)."""
    return items.groupBy("batch").agg(
        F.count_if(F.col("status") == "DONE").alias("done"),
        F.count_if(F.col("status").isin("QUEUED", "WORKING")).alias("active"),
        F.count_if((F.col("status") == "DONE") & F.coalesce("has_ai", F.lit(False))).alias("with_ai"),
    )


def capture_date(taken: Column) -> tuple[Column, Column]:
    """EXIF local time and offset of a timestamp in the session's time zone."""
    offset = F.date_format(taken, "xxx")
    return F.date_format(taken, "yyyy:MM:dd HH:mm:ss"), offset


def reencode_decision(fmt: Column, width: Column, height: Column, animated: Column, max_side: int = 0, heap_bytes: int = 512 << 20) -> dict[str, Column]:
    """What a re-encoding would do: target format, scale and whether frames are dropped. Pixels need a codec, which is
    not part of this engine."""
    budget = max(MIN_PIXELS, min(MAX_PIXELS, int(heap_bytes * 0.3 / 4)))
    side = F.greatest(width, height)
    by_side = F.when((F.lit(max_side) > 0) & (side > max_side), F.lit(max_side) / side).otherwise(F.lit(1.0))
    pixels = width.cast("double") * height * by_side * by_side
    scale = F.when(pixels > budget, by_side * F.sqrt(F.lit(float(budget)) / pixels)).otherwise(by_side)
    return {
        "target": F.when(fmt.isin("JPEG", "PNG", "WEBP"), fmt).when(fmt == "GIF", "PNG").otherwise("JPEG"),
        "scale": scale,
        "width": F.greatest(F.lit(1), F.round(width * scale).cast("int")),
        "height": F.greatest(F.lit(1), F.round(height * scale).cast("int")),
        "first_frame_only": animated,
    }
