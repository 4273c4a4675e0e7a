"""Streaming ingestion: arriving payloads, their batches and their states.

A failure belongs to its item. Progress, offsets and exactly-once results are Structured Streaming's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scrubline.functions.names import fresh
from scrubline.functions.text import TextOptions
from scrubline.operators.sanitize import clean_text
from scrubline.operators.strip import StripOptions
from scrubline.plans.media import clean_media

TERMINAL = ("DONE", "FAILED")
BINARY = "path string, modificationTime timestamp, length long, content binary"


def media_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Files as they arrive. Payloads come in small triggers, so a micro-batch fits in memory."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("text").option("wholetext", True).load(folder).withColumnRenamed("value", "text")


def process_batch(items: DataFrame, batch: int, options: StripOptions = StripOptions()) -> DataFrame:
    """One micro-batch: a path once, cleaned; (batch, path, status DONE or FAILED, has_ai, removed, data, error)."""
    cleaned = clean_media(items.dropDuplicates(["path"]), "content", options)
    done = F.col("status") == "CLEAN"
    return cleaned.select(
        F.lit(batch).cast("long").alias("batch"),
        "path",
        F.when(done, "DONE").otherwise("FAILED").alias("status"),
        F.exists("before.findings", lambda x: x["kind"].isin("C2PA", "AI_SOURCE_TYPE", "AI_GENERATOR", "AI_PARAMETERS")).alias("has_ai"),
        F.size("outcome.removed").alias("removed"),
        F.when(done, F.col("outcome.data")).alias("data"),
        F.when(~done, F.coalesce("outcome.reason", F.lit("residual metadata"))).alias("error"),
    )


def start(stream: DataFrame, out: str, checkpoint: str, options: Callable[[], StripOptions] = StripOptions):
    """Writes each micro-batch to ``out/batch=<id>``, replacing what an interrupted attempt left; options are read anew for
    each micro-batch."""

    def write(items: DataFrame, batch: int) -> None:
        process_batch(items, batch, options()).drop("batch").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def clean_text_stream(stream: DataFrame, options: TextOptions = TextOptions()) -> DataFrame:
    return clean_text(stream, "text", options)


def batch_finished(items: DataFrame) -> DataFrame:
    """Batches of which no item is queued or working: (batch, items, failed). items: (batch, id, status)."""
    return items.groupBy("batch").agg(F.bool_and(F.col("status").isin(*TERMINAL)).alias("finished"), F.count("*").alias("items"), F.count_if(F.col("status") == "FAILED").alias("failed")).where("finished").drop("finished")


def finished_once(events: DataFrame, time: str | None = None, delay: str = "1 hour", forget_after_ms: int = 3_600_000) -> DataFrame:
    """The same over a stream of (batch, id, status) events: each batch is reported once, when its last item ends.

    A reported batch keeps no items. With ``time`` (a timestamp column) it is forgotten ``forget_after_ms`` after the
    watermark, which trails by ``delay``; an event that comes still later begins it anew. Without, a mark of each reported
    batch stays. A batch with open items is kept.
    """

    def update(key: tuple, chunks: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, statuses, told = state.get if state.exists else ([], [], False)
        now = dict(zip(ids, statuses, strict=True))
        for chunk in chunks:
            now |= dict(zip(chunk["id"].tolist(), chunk["status"].tolist(), strict=True))
        over = told or bool(now) and all(s in TERMINAL for s in now.values())
        if over and not told:
            yield pd.DataFrame({"batch": [key[0]], "items": [len(now)], "failed": [sum(s == "FAILED" for s in now.values())]})
        state.update(([], [], True) if over else (list(now), list(now.values()), False))
        if over and time:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + forget_after_ms)

    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    timed = events.withWatermark(time, delay) if time else events
    return timed.groupBy("batch").applyInPandasWithState(update, "batch long, items long, failed long", "ids array<long>, statuses array<string>, told boolean", "append", timeout)


def apply_controls(items: DataFrame, controls: DataFrame) -> DataFrame:
    """Items after control rows (id, action): retry queues a finished item anew, remove drops it unless it is being
    worked on, clear drops finished ones, originals_deleted marks it."""
    wanted = controls.groupBy("id").agg(F.collect_set("action").alias("actions"))
    told = lambda a: F.coalesce(F.array_contains("actions", a), F.lit(False))
    joined = items.join(wanted, "id", "left")
    kept = joined.where(~(told("remove") & (F.col("status") != "WORKING")) & ~(told("clear") & F.col("status").isin(*TERMINAL)))
    status = F.when(told("retry") & F.col("status").isin(*TERMINAL), "QUEUED").otherwise(F.col("status"))
    return kept.select(*[c for c in items.columns if c not in ("status", "original_deleted")], status.alias("status"), (F.coalesce("original_deleted", F.lit(False)) | told("originals_deleted")).alias("original_deleted"))


def pending(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if(F.col("status").isin("QUEUED", "WORKING")).alias("pending"))


def debounced(edits: DataFrame, time: str = "ts", text: str = "text", key: str = "user_id") -> DataFrame:
    """The last text of each burst of edits: a burst ends after 60 ms without one, 250 ms for texts over 20,000 characters."""
    gap: Column = F.when(F.length(text) > 20_000, "250 milliseconds").otherwise("60 milliseconds")
    return edits.groupBy(key, F.session_window(time, gap).alias("burst")).agg(F.max_by(text, time).alias(text)).select(key, "burst.start", "burst.end", text)


def changed_only(edits: DataFrame, time: str = "ts", text: str = "text", key: str = "user_id") -> DataFrame:
    """Edits whose text differs from the one before."""
    from pyspark.sql import Window

    (before,) = fresh(edits, "before")
    last = F.lag(text).over(Window.partitionBy(key).orderBy(time))
    return edits.withColumn(before, last).where(~F.col(text).eqNullSafe(F.col(before))).drop(before)
