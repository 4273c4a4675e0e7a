"""Byte repeats by merging shard Burrows-Wheeler transforms.

Each fetching task is a shard. It sorts its suffixes at anchors (see ``repeats``) once and sends them in that order, each
with the symbols before it, which is what a Burrows-Wheeler transform keeps of a suffix. A bucket merges the shards by
refining an interleave: the vector that names, place by place, the shard that the next suffix comes from. Within its
shard a suffix is the next in order, so the vector alone says who stands where. It starts with one block per prefix,
shard after shard; each round partitions the blocks stably by the next eight bytes, which are ascending within a shard,
and where a block parts the length of the common prefix is known. No shard is sorted again and no suffix is compared as a
whole; a block of one suffix takes no part in later rounds, and rounds end when nothing can part any more.

Then the order is carried to longer suffixes by the transform's own step (the symbol before, stably), common prefixes by
range minima; intervals of places that share ``MIN_BYTES`` bytes are the repeats, and a suffix that stands for several
equal records is a repeat by itself.

Defined results: a null text is empty; a text shorter than MIN_BYTES has no repeats; rows with equal doc_id and equal
text get equal results and repeat each other; a null doc_id is a document like any other; an empty table gives no
rows; texts of any length and self-overlapping repeats are handled whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scrubline.llm import repeats
from scrubline.llm.repeats import Fragments, Windows

MIN_BYTES = 400
WORD = 8


def windows(min_bytes: int = MIN_BYTES) -> Windows:
    width = max(1, min_bytes * 8 // 25)
    return Windows(min_bytes, width, max(1, min(16, min_bytes - width + 1)), repeats.byte_symbols, False)


def _eight(f: Fragments, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The eight bytes from at on as one number, big end first; zero from end on."""
    value = np.zeros(len(at), np.uint64)
    for i in range(WORD):
        k = at + i
        byte = np.where(k < end, f.symbols[np.minimum(k, len(f.symbols) - 1)], 0).astype(np.uint64)
        value = value << np.uint64(8) | byte
    return value


def _rows_of(interleave: np.ndarray) -> np.ndarray:
    """The row at each place, rows being numbered shard by shard: each shard's suffixes come in their order."""
    rows = np.empty(len(interleave), np.int64)
    rows[np.argsort(interleave, kind="stable")] = np.arange(len(interleave))
    return rows


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """How many leading bytes of eight are equal; differ: the exclusive or of two big-endian numbers, never zero."""
    high = (differ >> np.uint64(32)).astype(np.float64)
    low = (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bits = np.where(high > 0, 31 - np.floor(np.log2(np.maximum(high, 1))), 63 - np.floor(np.log2(np.maximum(low, 1))))
    return bits.astype(np.int64) // 8


def merge_shards(shards: list[Fragments], w: Windows) -> tuple[Fragments, np.ndarray, np.ndarray, np.ndarray]:
    """The merged order of all suffixes of sorted shards: (fragments, rows, block by prefix, bytes shared with the row before)."""
    f = Fragments.join(shards)
    shard = np.repeat(np.arange(len(shards)), [len(x.key) for x in shards])
    begin = f.offset + f.left + w.prefix
    end = f.offset + f.size
    first = np.argsort(f.prefix, kind="stable")  # a merge of sorted runs: blocks by prefix, in each one shard after the other
    interleave = shard[first]
    block = np.cumsum(np.concatenate([[False], np.diff(f.prefix[first]) != 0]))
    fine = block.copy()
    shared = np.where(np.concatenate([[False], np.diff(block) == 0]), -1, 0).astype(np.int64)
    length = end - begin
    at = 0
    while True:
        rows = _rows_of(interleave)
        starts = np.concatenate([[True], np.diff(fine) != 0]) if len(fine) else np.zeros(0, bool)
        longest = np.maximum.reduceat(length[rows], np.flatnonzero(starts)) if len(fine) else length
        live = np.flatnonzero((np.bincount(fine)[fine] > 1) & (longest[fine] > at)) if len(fine) else np.zeros(0, np.int64)
        if not len(live):
            break
        word = _eight(f, begin[rows[live]] + at, end[rows[live]])
        by = np.lexsort((word, fine[live]))  # stable: a shard's suffixes stay in their order
        interleave[live], word = interleave[live][by], word[by]
        inside = np.concatenate([[False], np.diff(fine[live]) == 0])
        k = np.flatnonzero(inside & np.concatenate([[False], word[1:] != word[:-1]]))
        shared[live[k]] = w.prefix + at + _equal_bytes(word[k] ^ word[k - 1])
        starts[live[k]] = True
        fine = np.cumsum(starts) - 1
        at += WORD
    by = np.lexsort((length[rows], fine))  # equal to the end of the shorter one, which stands first and shares all of it
    interleave = interleave[by]
    rows = _rows_of(interleave)
    size = length[rows] + w.prefix
    least = np.minimum(size, np.concatenate([size[:1], size[:-1]]))
    shared = np.where(shared < 0, least, np.minimum(shared, least))
    return f, rows, block, shared


def repeated_bytes(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, text, spans) of each row of docs: the byte spans that repeated strings cover, which may overlap."""
    texts = repeats.keyed_texts(docs)
    return repeats.with_spans(texts, repeats.repeated_spans(texts, windows(min_bytes), merge_shards))


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cutter(with_text: bool):
    schema = _CUT if with_text else pa.schema(list(_CUT)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, text, spans in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = text.as_py() or b""
                gone = repeats.covered(len(text), spans.values if spans.is_valid else None)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                row = (doc_id.as_py(), len(text), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept)
                for column, v in zip(out, row):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def remove_repeated_bytes(docs: DataFrame, min_bytes: int = MIN_BYTES, with_text: bool = True) -> DataFrame:
    """CUT of each row of docs; without ``with_text`` the kept bytes stay behind."""
    schema = CUT if with_text else CUT.removesuffix(", kept binary")
    return repeated_bytes(docs, min_bytes).mapInArrow(_cutter(with_text), schema)


def op3_bwt_merge(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), x AS (
  SELECT doc_id, i, md5(substring(h, 2 * i + 1, 800)) AS k FROM d, unnest(range(0, length(h) // 2 - 399)) AS t(i)
), f AS (
  SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY k) > 1
), g AS (
  SELECT doc_id, i, CASE WHEN i <= max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 400 THEN 0 ELSE 1 END AS fresh FROM f
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run
), e AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER w AS before, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1 AS final FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY a)
), kept AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
    string_agg(substring(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN final THEN substring(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS h
  FROM e JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
