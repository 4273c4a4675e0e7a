"""Shared plumbing of the llm operators: shared scratch tables and sizing helpers."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space: what separates words everywhere in this subpackage (bytes.split() uses the same set).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows and bytes that a Python worker is handed at once; the session's own limits are 10,000 rows and 64 MB.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH for the session: texts then take little memory on both sides, and results are computed after a query has
    returned, so it can't be taken back. It changes no result."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir where set.

    Unset, a local master gets a temporary folder; any other master falls back to the warehouse, which all
    executors share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        root = "file://" + tempfile.mkdtemp(prefix="scrubline-")
        spark.conf.set("spark.checkpoint.dir", root)
        return root
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scrubline_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared scratch folder; it is deleted when the driver ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has already ended
        pass


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that no later stage reads."""
    _delete(spark, path)


#: So many shuffle partitions of numbers go into one task and file: partitions are counted for texts.
LIGHT = 8


def numbers(df: DataFrame, label: str) -> DataFrame:
    """materialize() for a table of a few numbers a row that a shuffle has dealt: LIGHT partitions make a file, but no fewer
    files than there are cores."""
    spark = df.sparkSession
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // LIGHT)
    return materialize(df.coalesce(max(parts, spark.sparkContext.defaultParallelism)), label)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df as a Parquet table in the shared scratch folder and reads it back.

    The table survives lost executors, and is read by column by each later stage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast. The engine broadcasts stored tables by their size on disk; numbers
    that compress well are many times larger as a hash table in the driver, and there grow with the input."""
    return df.hint("merge")


def discard(*stored: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in stored:
        _delete(df.sparkSession, df._scratch_path)


#: Rows of a sieve, 64 bits each: what is broadcast of one, whatever the input.
SIEVE_SLOTS = 1 << 17


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(SIEVE_SLOTS)).cast("int")


def _bit(key: Column) -> Column:
    return F.pow(F.lit(2), F.pmod(F.xxhash64(key, F.lit(6)), F.lit(62))).cast("long")


def sieve(keys: DataFrame) -> DataFrame:
    """A bit for each key of a one-column table, in SIEVE_SLOTS rows at most: see may_hold()."""
    key = F.col(keys.columns[0])
    return numbers(keys.select(_slot(key).alias("_slot"), _bit(key).alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits")), "sieve")


def sifted(df: DataFrame, key: Column, made: DataFrame) -> DataFrame:
    """df with ``_held``: false for rows whose key is surely not in the sieve, so that only the others need to move to be
    joined. The sieve is broadcast; its size is bounded by SIEVE_SLOTS. A full sieve saves nothing and loses nothing."""
    joined = df.withColumn("_slot", _slot(key)).join(F.broadcast(made), "_slot", "left")
    return joined.withColumn("_held", F.coalesce(F.col("_bits").bitwiseAND(_bit(key)) != 0, F.lit(False))).drop("_slot", "_bits")


def numbered(docs: DataFrame) -> DataFrame:
    """(_row, doc): a number that tells rows apart whatever their ids, and all columns of docs in a struct, where their
    names clash with none. It must be stored before it is used twice."""
    return docs.select(F.monotonically_increasing_id().alias("_row"), packed(docs))


def map_rows(docs: DataFrame, function: Callable, **places: str) -> DataFrame:
    """docs through function(batches, place=…, …), an Arrow function that returns rows of the same columns. It is told where
    the named columns stand; their names, which may hold dots, don't travel."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = functools.partial(function, **{k: names.index(n) for k, n in places.items()})
    return plain.mapInArrow(lambda batches: own(batches), plain.schema).toDF(*names)


def packed(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def told_apart(docs: DataFrame) -> DataFrame:
    """numbered(), stored; or, where doc_id is never null and never repeated, docs itself under _row = doc_id."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("_row"), packed(docs))
    return materialize(numbered(docs), "rows")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; used for partition counts only, never for results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions so that each holds about bytes_each of the estimated size, at least the session's shuffle count."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(min(200_000, max(least, plan_bytes(df) // bytes_each + 1)))
