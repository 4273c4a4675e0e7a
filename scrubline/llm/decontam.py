"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of each text.

Texts are lower-cased in A-Z and split into words of digits, letters and non-ASCII characters. A window is 13
consecutive words of an item; an item of fewer words (but not none) is one window. The automaton runs over word
numbers, so matches start and end at words; a match's word positions map back to code-point offsets in the text.

The benchmark is broadcast only while it holds at most MAX_ITEM_BYTES, and each worker process builds its automaton
once. A larger benchmark is dealt into groups of about that size, long items in pieces; each group scans the documents
once; rows are numbered and stored first, and the hits are united by that number. Nothing else is shuffled, and one
row's hits never meet those of another.

Defined results: null or empty texts have no words and no hits; a null item_id counts as the string ``null``; rows
with equal item_id are one item; an empty benchmark hits nothing; repeated documents are judged one by one; columns
other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scrubline.llm import common, worker
from scrubline.sources.tables import spread

WINDOW = 13
#: Bytes of benchmark text in one automaton.
MAX_ITEM_BYTES = 16 << 20
#: An item of more than this part of it is cut, so that groups come out even.
PIECES = 8
#: 20 * hit words >= words.
HIT_SHARE = 20

_ASCII_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B))
_NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c in _ASCII_WORD or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    if len(words) <= size:
        return [tuple(words)]
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class Matcher:
    """The automaton of one group of items."""

    def __init__(self, items: list[tuple[str, bytes | None]]):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            for window in windows_of(words_of(text)):
                key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window)
                owners.setdefault(key, set()).add(item_id)
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, ids in owners.items():
                self.automaton.add_word(key, (len(key), tuple(ids)))
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(first word, end word, item ids) of each window that occurs."""
        if self.automaton is None or not words:
            return []
        get = self.numbers.get
        numbers = tuple([get(w, 0) for w in words])
        if not any(numbers):
            return []
        return [(end + 1 - n, end + 1, ids) for end, (n, ids) in self.automaton.iter(numbers)]


def _matcher(spark: SparkSession, items: list[tuple[str, bytes | None]]) -> Callable[[], Matcher]:
    """Gives a task its worker's automaton: the items are broadcast once, and built into an automaton once per worker."""
    name = hashlib.sha256(repr(items).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(items)
    return lambda: worker.held(("matcher", name), lambda: Matcher(shared.value))


def _covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    steps = np.zeros(n + 1, np.int32)
    for a, b in spans:
        steps[a] += 1
        steps[b] -= 1
    return np.cumsum(steps[:n]) > 0


def _offsets(text: bytes) -> list[tuple[int, int]]:
    """Code-point offsets of the words of a text."""
    normal = np.frombuffer(text.translate(_NORMAL), np.uint8)
    inside = np.concatenate([[False], normal != 0x20, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return list(zip(points[edges[0::2]].tolist(), points[edges[1::2]].tolist(), strict=True))


_HITS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("item_ids", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
HITS = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"
#: The same of a numbered row.
_ROW_HITS = pa.schema([("_row", pa.int64()), *list(_HITS)[1:]])
ROW_HITS = HITS.replace("doc_id", "_row", 1)


def _scanner(spark: SparkSession, items: list[tuple[str, bytes | None]], schema: pa.Schema = _HITS):
    own = _matcher(spark, items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = own()
        for batch in batches:
            out: list[list] = [batch.column(0).to_pylist(), [], [], [], []]
            for text in batch.column(1):
                text = text.as_py() or b""
                words = words_of(text)
                hits = matcher.hits(words)
                spans, n_hit = [], 0
                if hits:
                    hit = _covered(len(words), [h[:2] for h in hits])
                    n_hit = int(hit.sum())
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    at = _offsets(text)
                    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edges[0::2], edges[1::2], strict=True)]
                out[1].append(len(words))
                out[2].append(n_hit)
                out[3].append(sorted({i for h in hits for i in h[2]}))
                out[4].append(spans)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    return scan


def _cutter(most: int):
    """Cuts items of more than ``most`` bytes into pieces that share WINDOW - 1 words, so each window is in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text) if text and len(text) > most else []
                if len(words) <= WINDOW:
                    pieces = [text]
                else:
                    pieces, at = [], 0
                    while at + WINDOW <= len(words):
                        stop, size = at + WINDOW, sum(map(len, words[at : at + WINDOW]))
                        while stop < len(words) and size < most:
                            size += len(words[stop]) + 1
                            stop += 1
                        pieces.append(b" ".join(words[at:stop]))
                        at = stop - WINDOW + 1
                ids += [item_id] * len(pieces)
                texts += pieces
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], names=["item_id", "text"])

    return run


def _groups(benchmark: DataFrame, max_bytes: int) -> Iterator[tuple[int, list[tuple[str, bytes | None]]]]:
    """(how many groups, items of one) for each group of about max_bytes of text; one is on the driver at a time."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("binary").alias("text")
    )
    size = F.octet_length("text")
    total, longest = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    n = int(total // max_bytes) + 1
    if longest > max_bytes // PIECES:
        rows = common.materialize(rows.mapInArrow(_cutter(max(1, max_bytes // PIECES)), "item_id string, text binary"), "items")
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield n, [(r.item_id, bytes(r.text) if r.text is not None else None) for r in part.collect()]


def _row_hits(rows: DataFrame, groups: Iterator[list[tuple[str, bytes | None]]]) -> DataFrame:
    """ROW_HITS, one row for each of the stored rows (_row, doc), over all groups of items."""
    texts = rows.select("_row", F.col("doc.text").cast("binary").alias("text"))
    found = None
    for items in groups:
        hits = common.materialize(texts.mapInArrow(_scanner(rows.sparkSession, items, _ROW_HITS), ROW_HITS).where("n_hit > 0"), "hits")  # one group is held at a time
        found = hits if found is None else found.unionAll(hits)
    runs = found.groupBy("_row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    keyed = texts.join(runs, "_row", "left").select("_row", "item_ids", "spans", "text")
    return keyed.mapInArrow(_unite, ROW_HITS)


def find_contamination(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """One row for each row of docs: HITS. spans: code-point offsets of the maximal hit runs, end exclusive."""
    groups = _groups(benchmark, max_bytes)
    n, items = next(groups)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if n == 1:
        return spread(texts).withColumn("text", F.col("text").cast("binary")).mapInArrow(_scanner(docs.sparkSession, items), HITS)
    rows = common.materialize(common.numbered(texts), "numbered")
    found = _row_hits(rows, itertools.chain([items], (i for _, i in groups)))
    return rows.select("_row", "doc.doc_id").join(found, "_row").select(_HITS.names)


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            at = _offsets(r["text"] or b"")
            starts = {a: i for i, (a, _) in enumerate(at)}
            ends = {b: i + 1 for i, (_, b) in enumerate(at)}
            hit = _covered(len(at), [(starts[s["start"]], ends[s["end"]]) for s in r["spans"] or ()])
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edges[0::2], edges[1::2], strict=True)]
            out.append({"_row": r["_row"], "n_words": len(at), "n_hit": int(hit.sum()), "item_ids": r["item_ids"] or [], "spans": spans})
        yield pa.RecordBatch.from_pylist(out, schema=_ROW_HITS)


def is_contaminated(n_hit="n_hit", n_words="n_words"):
    return (F.col(n_hit) > 0) & (F.lit(HIT_SHARE) * F.col(n_hit) >= F.col(n_words))


def _keeper(spark: SparkSession, items: list[tuple[str, bytes | None]]):
    own = _matcher(spark, items)

    def keep(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        matcher = own()
        for batch in batches:
            kept = []
            for text in batch.column(at):
                words = words_of((text.as_py() or "").encode())
                hits = matcher.hits(words)
                n_hit = int(_covered(len(words), [h[:2] for h in hits]).sum()) if hits else 0
                kept.append(not (n_hit > 0 and HIT_SHARE * n_hit >= len(words)))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return keep


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """docs without the contaminated rows, all columns kept; up to max_bytes of items the texts stay where they are."""
    groups = _groups(benchmark, max_bytes)
    n, items = next(groups)
    if n == 1:
        return common.map_rows(spread(docs), _keeper(docs.sparkSession, items), at="text")
    rows = common.materialize(common.numbered(docs), "numbered")
    bad = _row_hits(rows, itertools.chain([items], (i for _, i in groups))).where(is_contaminated()).select("_row")
    return rows.join(bad, "_row", "left_anti").select("doc.*")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 13) - 1) AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT len(win) AS l FROM iw), dw AS (
  SELECT doc_id, i, l, list_slice(w, i, i + l - 1) AS win FROM d, lens, unnest(range(1, len(w) - l + 2)) AS t(i)
), hits AS (
  SELECT DISTINCT dw.doc_id, dw.i, dw.l, iw.item_id FROM dw JOIN iw ON dw.win = iw.win
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + l)) AS u(p) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
