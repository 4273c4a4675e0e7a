"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features come from the text alone. Training takes the labelled documents outside the held-out fold, about
``max_rows`` of them at most (by a keyed hash of doc_id: a bounded, repeatable sample), bins each feature
by quantiles and grows trees level by level from gradient histograms. The trees are flattened into arrays, which
numpy walks for a whole batch at once. The model's size is bounded by its parameters, so it travels with the tasks.

Statistics are taken once: they are written to the shared scratch folder (a few numbers a document) and serve
both training and scoring. Texts are never shuffled; the only join brings labels to statistics by doc_id.

Defined results: a null or empty text has zero statistics and is scored like any other; a null label is no label; a
doc_id with two rows trains with both, and one with several labels with each of them; if no usable label exists
(or all are equal) the score is the share of label 1, or 0.5 without any; a null doc_id is scored and not held out;
repeated rows get equal scores; columns other than those named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scrubline.llm import common
from scrubline.llm.quality_rules import repeat_words
from scrubline.sources.tables import spread

THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

FEATURES = (
    "log_words", "log_chars", "mean_word", "sd_word", "short_words", "long_words", "symbol_share", "digit_share", "upper_share", "punct_share",
    "pipe_words", "symbol_words", "nonascii_share", "line_words", "dup_lines", "repeat_words", "distinct_words", "distinct_bigrams", "top_word",
    "word_entropy", "char_entropy", "stop_share", "sentence_words", "max_word", "caps_words", "bullet_lines", "end_punct_lines", "url_words",
)

#: Common short words of the corpus languages.
STOP = frozenset(
    b"the of and to in a is it that for with as on be at by this or an are was from und der die das ist nicht ein eine mit von zu den le la les de des et un une que en est dans pour el los las y es con por del se".split()
)
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _CLASS[_c] = (
        1 if chr(_c) in "#*$%&|<>" else 2 if 48 <= _c <= 57 else 3 if 65 <= _c <= 90 else 4 if chr(_c) in ".,;:!?\"'()-" else 5 if _c in (9, 10, 11, 12, 13, 32)
        else 6 if _c >= 0xC0 else 7 if _c >= 0x80 else 0
    )


def _entropy(counts: np.ndarray) -> float:
    n = counts.sum()
    return float(np.log2(n) - (counts * np.log2(counts)).sum() / n) if n else 0.0


def statistics(text: bytes | None) -> list[float]:
    """The FEATURES of one text."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    points = len(text) - int(kinds[7])
    sizes = np.fromiter(map(len, words), np.int64, n)
    codes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    _, counts = np.unique(codes, return_counts=True)
    pairs = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = text.count(b"|")
    byte_counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    sentences = text.count(b".") + text.count(b"!") + text.count(b"?")
    return [
        np.log1p(n), np.log1p(points), sizes.mean(), sizes.std(), (sizes <= 3).mean(), (sizes >= 12).mean(),
        kinds[1] / points, kinds[2] / points, kinds[3] / points, kinds[4] / points,
        symbols / n, sum(not w[-1:].isalnum() and w[-1] in b"#*$%&|<>" for w in words) / n, kinds[6] / points, n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), repeat_words(words) / n, len(counts) / n, len(np.unique(pairs)) / n, counts.max() / n,
        _entropy(counts), _entropy(byte_counts[byte_counts > 0]), sum(w in STOP for w in words) / n, n / max(1, sentences), sizes.max(),
        sum(w[:1].isupper() for w in words) / n, sum(x[:1] in b"-*#|" for x in lines) / max(1, len(lines)),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)), (text.count(b"://") + text.count(b"@")) / n,
    ]


@dataclass(frozen=True)
class Params:
    trees: int = 120
    depth: int = 4
    rate: float = 0.1
    bins: int = 64
    l2: float = 1.0
    min_hessian: float = 2.0
    #: Bound of the training sample, which goes to the driver: 40,000 rows of 28 floats are 9 MB.
    max_rows: int = 40_000


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: row t holds tree t; node i's children are 2i+1 and 2i+2; a leaf has feature -1."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                below = 2 * node + 1 + (x[rows, np.maximum(f, 0)] > threshold[node])
                node = np.where(f < 0, node, below)
            margin += value[node]
        return 1 / (1 + np.exp(-margin))


def train(x: np.ndarray, y: np.ndarray, p: Params) -> Forest:
    """Second-order boosting of the logistic loss on binned features."""
    n_nodes = 2 ** (p.depth + 1) - 1
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        exact = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        empty = np.zeros((0, n_nodes))
        return Forest(float(np.log(exact / (1 - exact))), empty.astype(np.int64), empty, empty, p.depth)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin > k  <=>  x > edges[k]
    flat = binned + np.arange(m) * p.bins
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        feature, threshold, value = np.full(n_nodes, -1), np.zeros(n_nodes), np.zeros(n_nodes)
        node = np.zeros(n, np.int64)
        for level in range(p.depth + 1):
            first, width = 2**level - 1, 2**level
            live = node >= first
            local = node[live] - first
            g = np.bincount(local, grad[live], width)
            h = np.bincount(local, hess[live], width)
            value[first : first + width] = -p.rate * g / (h + p.l2)
            if level == p.depth:
                break
            cells = (local[:, None] * (m * p.bins) + flat[live]).ravel()
            hg = np.bincount(cells, np.repeat(grad[live], m), width * m * p.bins).reshape(width, m, p.bins).cumsum(2)
            hh = np.bincount(cells, np.repeat(hess[live], m), width * m * p.bins).reshape(width, m, p.bins).cumsum(2)
            gain = hg**2 / (hh + p.l2) + (g[:, None, None] - hg) ** 2 / (h[:, None, None] - hh + p.l2) - (g**2 / (h + p.l2))[:, None, None]
            gain[(hh < p.min_hessian) | (h[:, None, None] - hh < p.min_hessian)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(width, -1).argmax(1)
            top = gain.reshape(width, -1)[np.arange(width), best]
            for k in np.flatnonzero(top > 1e-6):
                j, b = divmod(int(best[k]), p.bins)
                feature[first + k], threshold[first + k] = j, edges[j][b]
            f = feature[node]
            go = live & (f >= 0)
            node[go] = 2 * node[go] + 1 + (x[np.flatnonzero(go), f[go]] > threshold[node[go]])
        margin += value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(base, np.array(features), np.array(thresholds), np.array(values), p.depth)


_STATS = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float32()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], schema=_STATS)


def document_statistics(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return spread(texts).mapInArrow(_measure, "doc_id long, stats array<float>")


def fold_of(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def fit(stats: DataFrame, labels: DataFrame, params: Params = Params()) -> Forest:
    """Trains on the labelled rows outside the held-out fold: on all, or where they are more than ``max_rows`` on those
    whose keyed hash of doc_id is below a limit that leaves about as many (never more than 1.5 times)."""
    known = labels.where(F.col("quality").isNotNull() & (fold_of() != HELD_OUT)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = min(1.0, params.max_rows / max(1, known.count()))
    chosen = known.where(F.abs(F.xxhash64("doc_id", F.lit(11)) / 2) <= share * 2.0**62)
    rows = chosen.join(stats, "doc_id").select("doc_id", "quality", "stats").limit(params.max_rows * 3 // 2).toPandas()
    x = np.array(rows["stats"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T[:2], rows["quality"].to_numpy(), rows["doc_id"].to_numpy()))
    return train(x[order], rows["quality"].to_numpy(np.float64)[order], params)


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) of each row of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.scores(x))], schema=_SCORES)

    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    stats = common.materialize(document_statistics(docs), "quality-stats")
    return score(stats, fit(stats, labels, params)).select(
        "doc_id",
        F.coalesce(fold_of() == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op10_quality_gbt(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT
