"""Near-duplicates by similarity: the SimHash grid and MinHash bands find candidates, the exact Jaccard similarity decides.

A document is the set of the XXH64 values of its word shingles (``SHINGLE`` = 5 words). Two documents link at a Jaccard
similarity of ``SIMILARITY`` = 0.8 or more; documents of one set are one node throughout, so groups of exact copies
never meet in a cell.

Candidates by SimHash: each node has a fingerprint over the same shingles, and fingerprints within 2 bits meet by the
segment grid of ``simhash.links``; nodes of one fingerprint meet its smallest node. Most pairs at 0.8 lie beyond 2 bits.

Candidates by bands: ``BANDS`` keys a node, each of ``ROWS`` minima. A pair shares a key with probability
1 - (1 - J ** ROWS) ** BANDS: at J = 0.8 all but 5 in 100 million pairs. Each candidate is then checked on the sets.

Cells of more than ``CELL_LIMIT`` nodes (a crowd) are never paired out. Each member is checked against the ``LEADERS``
leaders of the cell: its most central member (the one that the most and largest crowded cells share, so that cells of
one crowd agree on it) and some chosen by hash. Components of these links are formed; cells of one central member are one
group from then on. Pairs inside a group's largest component need no check. Members outside it are dealt into blocks of
about ``BLOCK`` nodes, and so are all members; a task compares one block with another on the sets themselves and returns
links that join what is similar, at most one a node and not one a pair. So components are those of all candidates.

Defined results: letters A-Z are lower-cased; a text of fewer than five words is one shingle; null or wordless texts are
equal to each other; texts of any length are compared whole; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from scrubline.llm import common
from scrubline.llm.components import components
from scrubline.llm.simhash import links as grid_links, majority, shingle_hashes
from scrubline.sources.tables import spread

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
CELL_LIMIT, LEADERS = 16, 4
#: Nodes, and bytes of their sets, in a block.
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: A shingle with more pairs than this between two blocks is counted by a matrix product.
DENSE = 256

_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", size))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def band_keys(shingles: np.ndarray) -> list[int]:
    """BANDS keys as signed numbers; of an empty set none."""
    if not len(shingles):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, ((shingles[at : at + 1024] ^ _XOR) * _ODD).min(1), out=low)
    return [_signed(xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k)) for k in range(BANDS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """counts[i, j]: shingles that left[i] and right[j] have in common."""
    counts = np.zeros((len(left), len(right)), np.int64)
    everything = np.concatenate([*left, *right, np.zeros(0, np.uint64)])
    codes = np.unique(everything, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    first = owner < len(left)
    a, b = (np.bincount(codes[side], minlength=int(codes.max(initial=-1)) + 1) for side in (first, ~first))
    heavy = a * b > DENSE
    chosen = np.flatnonzero(heavy)
    number = np.cumsum(heavy) - 1
    for at in range(0, len(chosen), 4096):
        planes = [np.zeros((len(side), 4096), np.float32) for side in (left, right)]
        mine = heavy[codes] & (number[codes] >= at) & (number[codes] < at + 4096)
        for plane, side, shift in zip(planes, (first, ~first), (0, len(left)), strict=True):
            plane[owner[mine & side] - shift, number[codes[mine & side]] - at] = 1
        counts += (planes[0] @ planes[1].T).astype(np.int64)
    light = ~heavy[codes]
    by = np.flatnonzero(light & ~first)
    by = by[np.argsort(codes[by], kind="stable")]
    begin = np.searchsorted(codes[by], np.arange(len(a)))
    mine = np.flatnonzero(light & first)
    times = b[codes[mine]]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    other = owner[by[np.repeat(begin[codes[mine]], times) + step]] - len(left)
    np.add.at(counts, (np.repeat(owner[mine], times), other), 1)
    return counts


def joined_nodes(left: np.ndarray, right: np.ndarray, similar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), one for each node but the smallest of each component of the given pairs, to the smallest one."""
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = np.nonzero(similar)
    i, j = place[i], place[len(left) + j]
    low, last = np.arange(len(nodes)), None
    while last is None or (low != last).any():
        last = low.copy()
        np.minimum.at(low, i, last[j])
        np.minimum.at(low, j, last[i])
        low = low[low]
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[low[moved]], nodes[moved]


def _nodes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, keys, prints = [], [], []
        for text in batch.column(1):
            hashes = shingle_hashes(text.as_py() or b"", size)
            prints.append(majority(hashes))
            shingles = np.unique(hashes)
            nodes.append(_signed(xxhash.xxh64_intdigest(shingles.tobytes())))
            keys.append(band_keys(shingles))
        columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["_row", "_node", "_keys", "_print"])


def _similar(batches: Iterator[pa.RecordBatch], size: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = functools.lru_cache(64)(functools.partial(shingle_set, size=size))
        a, b, left, right = (batch.column(i) for i in range(4))
        linked = [similarity(sets(x.as_py()), sets(y.as_py())) >= least for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _texts_of(met: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(n, text) of the nodes met (n): a stored table. Only texts that may be needed leave their place."""
    first = common.numbers(nodes.join(met, nodes._node == met.n).select("n", "first"), "met")
    held = common.sieve(first.select("first"))
    near = common.sifted(texts, F.col("_row"), held).where("_held")
    found = common.materialize(near.join(first, F.col("_row") == F.col("first")).select("n", "text"), "texts")
    common.discard(first, held)
    return found


def _checked(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough. Each side of a join is a stored table."""
    pairs = common.numbers(pairs.distinct(), "pairs")
    found = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct(), nodes, texts)
    left = found.select(F.col("n").alias("a"), F.col("text").alias("ta"))
    right = found.select(F.col("n").alias("b"), F.col("text").alias("tb"))
    held = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    similar = common.materialize(held.mapInArrow(functools.partial(_similar, size=size, least=least), "a long, b long"), "similar")
    common.discard(pairs, found)
    return similar


def _block_links(least: float):
    """Links between the nodes of two blocks: rows (..., side, n, shingles)."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, sets = table.column("n").to_numpy(), [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        at = [np.flatnonzero(side == k) for k in (0, 1)]
        left, right = ([sets[k] for k in own] for own in at)
        both = shared_counts(left, right)
        sizes = [np.array([len(x) for x in own], np.int64) for own in (left, right)]
        similar = both / np.maximum(sizes[0][:, None] + sizes[1][None, :] - both, 1) >= least
        a, b = joined_nodes(ids[at[0]], ids[at[1]], similar)
        return pa.table({"a": a, "b": b})

    return run


def _crowd_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py(), size).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["n", "shingles"])


def _across(members: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, least: float) -> DataFrame:
    """Links of the members outside their group's largest component to the group. members (grp, n, out): a stored table."""
    met = _texts_of(members.select("n").distinct(), nodes, texts)
    sets = common.materialize(met.mapInArrow(functools.partial(_crowd_sets, size=size), "n long, shingles binary"), "sets")
    held = common.materialize(members.join(sets, "n"), "held")
    weight = F.octet_length("shingles")
    need = lambda n, b: F.ceil(F.greatest(n / BLOCK, b / BLOCK_BYTES)).cast("int")
    per = held.groupBy("grp").agg(
        need(F.count("*"), F.sum(weight)).alias("n_all"),
        need(F.count_if("out"), F.sum(F.when(F.col("out"), weight).otherwise(0))).alias("n_out"),
    )
    dealt = held.join(common.numbers(per, "blocks"), "grp")
    whose = lambda seed, n: F.pmod(F.xxhash64("n", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = dealt.where("out").select("grp", whose(1, "n_out").alias("i"), each("n_all").alias("j"), F.lit(0).alias("side"), "n", "shingles")
    inner = dealt.select("grp", each("n_out").alias("i"), whose(2, "n_all").alias("j"), F.lit(1).alias("side"), "n", "shingles")
    found = outer.unionAll(inner).groupBy("grp", "i", "j").applyInArrow(_block_links(least), "a long, b long")
    links = common.materialize(found, "across")
    common.discard(met, sets, held)
    return links


def _grid_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) of nodes by their fingerprints. Fingerprints that the grid joins are stood for by their smallest
    nodes. nodes: a stored table."""
    prints = common.numbers(nodes.groupBy("fp").agg(F.min("_node").alias("low")), "prints")
    near = grid_links(prints.select("fp")).select(F.col("a").alias("fp"), F.col("b").alias("_b"))
    near = common.numbers(near.join(common.merged(prints), "fp").select(F.col("_b").alias("fp"), F.col("low").alias("n")), "near")
    equal = nodes.join(common.merged(prints), "fp").where("_node <> low").select(F.col("low").alias("n"), F.col("_node").alias("m"))
    met = near.join(common.merged(prints), "fp").select("n", F.col("low").alias("m")).union(equal)
    return met.select(F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b"))


def _joined(rows: DataFrame, texts: DataFrame, size: int, least: float, cell_limit: int) -> DataFrame:
    """(node, component) of the nodes that have a link. rows: a stored table of _row, _node, _keys, _print; texts: (_row, text)."""
    nodes = common.numbers(rows.groupBy("_node").agg(F.min("_row").alias("first"), F.min("_keys").alias("keys"), F.min("_print").alias("fp")), "nodes")
    around = nodes.select(F.col("_node").alias("n"), F.explode("keys").alias("cell"))
    sizes = around.groupBy("cell").count().where("count > 1")
    cells = common.numbers(around.join(sizes, "cell"), "cells")  # of most nodes no cell is shared
    few = cells.where(F.col("count") <= cell_limit)
    a, b = few.select("cell", F.col("n").alias("a")), few.select("cell", F.col("n").alias("b"))
    pairs = a.join(b, "cell").where("a < b").select("a", "b").union(_grid_pairs(nodes))
    crowd = cells.where(F.col("count") > cell_limit)
    if crowd.isEmpty():
        return components(_checked(pairs, texts, nodes, size, least))
    score = common.numbers(crowd.groupBy("n").agg(F.sum("count").alias("score")), "score")
    placed = common.numbers(crowd.join(score, "n").select("cell", "n", "score"), "placed")
    some = [F.min_by("n", F.xxhash64("n", F.lit(k))) for k in range(1, LEADERS)]
    head = F.max_by("n", F.struct("score", "n"))
    lead = common.numbers(placed.groupBy("cell").agg(head.alias("grp"), F.array_distinct(F.array(head, *some)).alias("leaders")), "leaders")
    stars = placed.join(lead, "cell").select("n", F.explode("leaders").alias("m")).where("n <> m")
    links = _checked(pairs.union(stars.select(F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b"))), texts, nodes, size, least)
    found = common.numbers(components(links), "found")
    grouped = placed.join(lead.select("cell", "grp"), "cell").select("grp", "n").distinct()
    owned = grouped.join(found, grouped.n == found.node, "left").select("grp", "n", F.coalesce("component", "n").alias("c"))
    owned = common.numbers(owned, "owned")
    counts = owned.groupBy("grp", "c").agg(F.count("*").alias("k"))
    main = counts.groupBy("grp").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    members = owned.join(common.numbers(main, "main"), "grp").select("grp", "n", (F.col("c") != F.col("main")).alias("out"))
    return components(links.union(_across(common.numbers(members, "members"), texts, nodes, size, least)))


def first_of_each(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group the row with the smallest doc_id (among equal ids the one with the smallest hash of text), and all
    rows without doc_id. rows: (_row, doc) of told_apart(); groups: a stored table (_row, component).

    Only rows that may go are joined with those that do; all others stay where they are.
    """
    order = F.struct("doc_id", "hash", "_row")
    # stored, as all sides of joins here, so that the engine can split a component that holds very many rows
    shared = common.numbers(groups.groupBy("component").count().where("count > 1").select("component"), "large")
    some = common.numbers(groups.join(shared, "component"), "shared")
    held = common.sieve(some.select("_row"))
    near = common.sifted(rows.where("doc.doc_id is not null").select("_row", F.col("doc.doc_id"), "doc.text"), F.col("_row"), held).where("_held")
    named = near.select("_row", "doc_id", F.xxhash64("text").alias("hash")).join(some, "_row")
    named = common.materialize(named, "named")
    best = common.numbers(named.groupBy("component").agg(F.min(order)["_row"].alias("best")), "best")
    gone = common.numbers(named.join(best, "component").where("_row <> best").select("_row"), "gone")
    common.discard(shared, some, held, named, best)
    maybe = common.sifted(rows, F.col("_row"), common.sieve(gone))
    return maybe.where("not _held").select("doc.*").unionAll(maybe.where("_held").join(gone, "_row", "left_anti").select("doc.*"))


def keep_one(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """docs without all but one row of each component of similar documents (first_of_each). A row without doc_id can't
    be told apart and always stays. docs is read several times, so it should be a stored table."""
    rows = common.told_apart(docs)
    texts = rows.select("_row", F.col("doc.text").cast("binary").alias("text"))
    nodes = common.materialize(spread(texts).mapInArrow(functools.partial(_nodes, size=size), "_row long, _node long, _keys array<long>, _print long"), "rows")
    found = common.numbers(_joined(nodes, texts, size, least, cell_limit), "components")
    groups = nodes.select("_row", "_node").join(found, F.col("_node") == F.col("node"), "left")
    return first_of_each(rows, common.numbers(groups.select("_row", F.coalesce("component", "_node").alias("component")), "groups"))
