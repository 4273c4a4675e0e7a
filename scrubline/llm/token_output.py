"""Token-id output: a shared zstandard dictionary, one frame per document, an offset index.

File format: a Parquet data set of shards, written by Spark's committer, so a lost executor leaves no half file and
any store that Spark can write will do. A shard row holds consecutive documents in ascending doc_id order: ``blob`` is
their frames end to end, each one document's ids (little-endian unsigned 32-bit, end id included) compressed on its
own under the shared dictionary; ``offsets`` (one more than documents) index the blob; ``doc_ids`` and ``n_tokens``
say whose they are; ``dict_sha256`` names the dictionary, which lies beside the shards. One document is read by its
slice of one blob. Shards of one range partition follow each other by ``seq``; partitions ascend with doc_id.

The dictionary is trained on the ids of about ``sample_docs`` documents, at most twice as many (those with a keyed hash
of doc_id below a limit, among texts of at most ``sample_bytes`` bytes), a bound that doesn't grow with the corpus; it
affects sizes only. Documents move once, to their range partition, as text.

Defined results: a null or empty text is the end id alone; rows with equal doc_id follow each other in the order of
their texts; null doc_ids come first; an empty table gives an empty data set; too few or too uniform documents for
training give frames without dictionary (empty ``dict_sha256``); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from scrubline.llm import common
from scrubline.llm.encoding import ByteLevelEncoder, encoder, pack

END_ID = 0


@dataclass(frozen=True)
class Format:
    tokenizer_path: str
    level: int = 3
    dict_bytes: int = 64 << 10
    sample_docs: int = 600
    sample_bytes: int = 32 << 10
    shard_bytes: int = 4 << 20
    shard_docs: int = 4_096


_SHARD = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("dict_sha256", pa.string()), ("start", pa.int64()), ("total", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("blob", pa.binary()),
    ]
)
SHARD = "part int, seq int, dict_sha256 string, start long, total long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, blob binary"


def train_dictionary(docs: DataFrame, fmt: Format) -> bytes:
    """The dictionary, or nothing if the sample can't give one."""
    share = min(1.0, fmt.sample_docs / max(1, docs.count()))
    chosen = docs.where(F.abs(F.xxhash64("doc_id", F.lit(7)) / 2) <= share * 2.0**62)
    rows = chosen.where(F.octet_length("text").between(1, fmt.sample_bytes)).select("text").limit(2 * fmt.sample_docs).collect()
    encode = encoder(ByteLevelEncoder, fmt.tokenizer_path)
    samples = sorted(encode(r.text) + pack([END_ID]) for r in rows)
    try:
        return zstandard.train_dictionary(fmt.dict_bytes, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, path: str, fmt: Format) -> None:
    """Writes the data set: path/dictionary and path/shards."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(texts, fmt)
    sha = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
    spark.createDataFrame([(sha, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        encode = encoder(ByteLevelEncoder, fmt.tokenizer_path)
        end = pack([END_ID])
        squeeze = zstandard.ZstdCompressor(level=fmt.level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
        ids, counts, frames, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            values = [part, seq, sha, start, sum(counts), ids, counts, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SHARD, strict=True)], schema=_SHARD)

        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                raw = encode(t.as_py()) + end
                frame = squeeze(raw)
                ids.append(d.as_py())
                counts.append(len(raw) // 4)
                frames.append(frame)
                size += len(frame)
                if size >= fmt.shard_bytes or len(ids) >= fmt.shard_docs:
                    yield row()
                    seq, start = seq + 1, start + sum(counts)
                    ids, counts, frames, size = [], [], [], 0
        if ids:
            yield row()

    n = common.partitions_for(texts, 64 << 20)
    ordered = texts.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(shards, SHARD).write.parquet(f"{path}/shards")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    r = spark.read.schema("dict_sha256 string, dictionary binary").parquet(f"{path}/dictionary").first()
    return r.dict_sha256, bytes(r.dictionary)


def _opener(sha: str, dictionary: bytes):
    def open_frame(named: str):
        if named != sha:
            raise ValueError(f"the shard needs dictionary {named}, the data set has {sha}")
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    return open_frame


_READ = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: every frame is opened and its ids counted and summed."""
    open_frame = _opener(*_dictionary(spark, path))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, _, sha, start, _, ids, _, offsets, blob = (batch.column(k)[r] for k in range(len(_SHARD)))
                blob, offsets, start = memoryview(blob.as_buffer()), offsets.as_py(), start.as_py()
                opened, out = open_frame(sha.as_py()), ([], [], [])
                for a, b in zip(offsets, offsets[1:]):
                    raw = opened(blob[a:b])
                    for column, v in zip(out, (start, len(raw) // 4, zlib.crc32(raw)), strict=True):
                        column.append(v)
                    start += len(raw) // 4
                columns = [pa.array([part.as_py()] * len(out[0]), pa.int32()), pa.array(ids.as_py(), pa.int64()), *(pa.array(c, pa.int64()) for c in out)]
                yield pa.RecordBatch.from_arrays(columns, schema=_READ)

    shards = spark.read.schema(SHARD).parquet(f"{path}/shards")
    # one number per range partition: a few bytes each, whatever the corpus
    totals = dict(shards.groupBy("part").agg(F.sum("total")).collect())
    bases, run = [], 0
    for part in sorted(totals):
        bases.append((part, run))
        run += totals[part]
    base = spark.createDataFrame(bases, "part int, base long")
    rows = shards.mapInArrow(read, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, list[list[int]]]:
    """Short-document access: the ids of a few documents, opening only their slices."""
    open_frame = _opener(*_dictionary(spark, path))
    wanted = F.array(*[F.lit(i).cast("long") for i in doc_ids])
    found: dict[int, list[list[int]]] = {i: [] for i in doc_ids}
    slices = (
        spark.read.schema(SHARD).parquet(f"{path}/shards").where(F.arrays_overlap("doc_ids", wanted))
        .select("dict_sha256", "blob", "offsets", F.posexplode("doc_ids").alias("k", "doc_id")).where(F.array_contains(wanted, F.col("doc_id")))
        .selectExpr("dict_sha256", "doc_id", "substring(blob, cast(offsets[k] + 1 as int), cast(offsets[k + 1] - offsets[k] as int)) AS frame")
    )
    for r in slices.collect():
        found[r.doc_id].append(np.frombuffer(open_frame(r.dict_sha256)(bytes(r.frame)), "<u4").tolist())
    return found


def production_format() -> Format:
    import public_tokenizers

    return Format(public_tokenizers.path("byte_bpe_50k.json"))


def op5_token_frames(spark, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "token-frames")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, production_format())
    return read_index(spark, path)
