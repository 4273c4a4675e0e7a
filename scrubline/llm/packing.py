"""Best-fit packing by exact-complement hashing.

Documents are encoded, cut only where longer than a sequence, and their pieces counted by length: at most ``capacity``
counts, whatever the corpus. On these counts the planner fills sequences: the longest available piece first, then
others until at most three can close the gap, then the single, pair or triple of available lengths whose sum is
exactly the gap, found by looking up complements; where no combination closes it, the best fitting piece. Each filling
is repeated as often as its counts allow, so a plan has a bounded number of patterns (each uses up some length) and is
small enough to travel with the tasks. Pieces then take their places by rank within their length.

Ranks come from counts per (length, salt), so a length shared by a third of all pieces is split over all salts.
Texts are never shuffled; after encoding only the pieces' numbers move, once.

Defined results: a null or empty text is the end id alone; rows with equal doc_id are documents of their own; an empty
table gives no rows; a piece of the full capacity fills a sequence by itself; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scrubline.llm import common
from scrubline.llm.encoding import MEMO_WORDS, WordEncoder, encoder, pack
from scrubline.sources.tables import spread

END_ID = 1
CAPACITY = 4096


class ComplementIndex:
    """Counts of available lengths, with look-up of combinations that sum to a gap exactly."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def take(self, lengths: list[int], n: int = 1) -> None:
        for x in lengths:
            self.counts[x] -= n

    def largest(self, most: int) -> int:
        """The longest available length of at most most, or 0."""
        at = np.flatnonzero(self.counts[1 : most + 1])
        return int(at[-1]) + 1 if len(at) else 0

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.counts[gap] > 0 else None

    def pair(self, gap: int, most: int) -> list[int] | None:
        """Two lengths of at most most; the pair that can be repeated most often."""
        low, high = (gap + 1) // 2, min(most, gap - 1)
        if low > high:
            return None
        a = self.counts[low : high + 1]
        b = self.counts[gap - high : gap - low + 1][::-1]
        n = np.minimum(a, b)
        if 2 * low == gap:
            n[0] = a[0] // 2
        k = int(n.argmax())
        return [low + k, gap - low - k] if n[k] > 0 else None

    def triple(self, gap: int, most: int) -> list[int] | None:
        for c in (np.flatnonzero(self.counts[1 : min(most, gap - 2) + 1]) + 1)[::-1].tolist():
            if 3 * c < gap:
                return None
            self.counts[c] -= 1
            rest = self.pair(gap - c, c)
            self.counts[c] += 1
            if rest:
                return [c, *rest]
        return None

    def complement(self, gap: int) -> list[int] | None:
        most = self.largest(gap)
        if not most or 3 * most < gap:
            return None
        return self.single(gap) or self.pair(gap, most) or self.triple(gap, most)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, how often) of each pattern; counts[n]: pieces of length n, n from 0 to capacity."""
    index = ComplementIndex(counts.astype(np.int64).copy())
    out: list[tuple[list[int], int]] = []
    while first := index.largest(capacity):
        pattern, gap = [first], capacity - first
        index.take(pattern)
        while gap:
            if rest := index.complement(gap):
                index.take(rest)
                pattern += rest
                break
            best = index.largest(gap)
            if not best:
                break
            index.take([best])
            pattern.append(best)
            gap -= best
        index.take(pattern, -1)
        times = min(int(index.counts[x]) // k for x, k in Counter(pattern).items())
        index.take(pattern, times)
        out.append((pattern, times))
    return out


@dataclass(frozen=True)
class Slots:
    """The plan as arrays sorted by key = length * 2**40 + first rank."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(patterns: list[tuple[list[int], int]]) -> Slots:
        used: Counter[int] = Counter()
        rows, sequence = [], 0
        for pattern, times in patterns:
            at = 0
            for x in pattern:
                rows.append(((x << 40) + used[x], sequence, at))
                used[x] += times
                at += x
            sequence += times
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        return Slots(table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy())

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece by its length and its rank (from 0) among pieces of that length."""
        key = (length << 40) + rank
        k = np.searchsorted(self.key, key, side="right") - 1
        return self.sequence[k] + key - self.key[k], self.offset[k]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PACKED = PIECES + ", sequence_id long, offset long"


def encode_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, memo_words: int = MEMO_WORDS) -> DataFrame:
    """One row of PIECES for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(WordEncoder, tokenizer_path, memo_words), pack([end_id])
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                raw = memoryview(encode(t.as_py()) + end)
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for column, v in zip(out, (d.as_py(), k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """PACKED: each piece with its sequence and place. ``pieces`` is read twice, so it should be a stored table."""
    found = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["count"]
    slots = Slots.of(plan(counts, capacity))

    salts = common.partitions_for(pieces, 32 << 20)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    per_salt = salted.groupBy("length", "salt").count()
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = per_salt.select("length", "salt", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            sequence, offset = slots.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*_PIECES.names, "sequence_id", "offset"])

    return ranked.select(*_PIECES.names, (F.col("before") + F.col("own") - 1).alias("rank")).mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, memo_words: int = MEMO_WORDS) -> DataFrame:
    """PACKED of all pieces of docs. memo_words: how many encoded words a worker process keeps."""
    return pack_pieces(common.materialize(encode_pieces(docs, tokenizer_path, capacity, end_id, memo_words), "pieces"), capacity)


def production_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_exact_complement(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), production_tokenizer())
