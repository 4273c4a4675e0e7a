"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact check.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 values of the document's word shingles.
Two fingerprints link at ``RADIUS`` = 2 or fewer differing bits.

Embedding: the fingerprint's 16 segments of 4 bits map to their bit counts. Differing bits bound the Manhattan distance
of the embeddings from above, so only fingerprints within Manhattan distance 2 can link. Grid range join: two points of
the integer grid within distance 2 have a grid point within distance 1 of both, so each fingerprint is put into its own
cell and the 32 next to it (33 in all, a fixed number) and candidates are those that meet in a cell, by an equi-join
on the cell number. Each candidate pair is then checked on the fingerprints themselves.

No cell is paired out beyond ``CELL_LIMIT`` members. The members of a fuller cell take the same step with segments of one
bit: each goes to its own fingerprint and its 64 neighbours of one bit; all that meet there differ by at most 2 bits,
so one link from the smallest to each other member loses no connection, and no pair is made. Equal fingerprints are
one node throughout, so groups of exact copies never meet in a cell.

Defined results: letters A-Z are lower-cased; a text of fewer than three words is one shingle; a null or wordless text
has fingerprint zero and links like any other; a null doc_id takes part but is never a component's name (a component
of null ids only has a null name); repeated rows are returned as often as they come; texts of any length are hashed
whole; an empty table gives no rows; other columns are ignored or, by ``keep_one``, handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from scrubline.llm import common
from scrubline.llm.components import components
from scrubline.sources.tables import spread

SHINGLE, SEED, RADIUS = 3, 42, 2
SEGMENTS, SEGMENT_BITS = 16, 4
CELL_LIMIT = 16


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()  # bytes.lower() changes A-Z only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - size + 1].tolist()
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64, n - size + 1)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    return majority(shingle_hashes(text or b""))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed number."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())], schema=_FP)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return spread(texts).mapInArrow(_prints, "doc_id long, fp long")


def grid_cells(fp: Column) -> tuple[Column, list[Column]]:
    """A fingerprint's own cell and the steps to the next ones. A cell is numbered by its counts plus one, 3 bits each:
    48 bits, no collisions."""
    mask = F.lit((1 << SEGMENT_BITS) - 1)
    point = F.lit(0).cast("long")
    for i in range(SEGMENTS):
        count = F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(mask)).cast("long")
        point = point.bitwiseOR(F.shiftleft(count + 1, 3 * i))
    step = [F.lit(1 << (3 * i)).cast("long") for i in range(SEGMENTS)]
    return point, step


def bit_neighbours(fp: Column) -> Column:
    return F.array(fp, *[fp.bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")) for i in range(64)])


def links(prints: DataFrame, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints: all pairs within RADIUS that meet in an ordinary cell, and for fuller
    cells links that join the same fingerprints into the same components. prints: (fp), distinct, a stored table."""
    point, step = grid_cells(F.col("fp"))
    around = prints.select("fp", point.alias("p")).select("fp", F.explode(F.array("p", *[F.col("p") + s for s in step], *[F.col("p") - s for s in step])).alias("cell"))
    sizes = around.groupBy("cell").count().where("count > 1")
    cells = common.numbers(around.join(common.merged(sizes), "cell"), "cells")  # of most fingerprints no cell is shared
    few = cells.where(F.col("count") <= cell_limit).select("cell", "fp")
    a, b = few.select("cell", F.col("fp").alias("a")), few.select("cell", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = a.join(common.merged(b), "cell").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    crowd = cells.where(F.col("count") > cell_limit).select("fp").distinct()
    balls = crowd.select("fp", F.explode(bit_neighbours(F.col("fp"))).alias("middle"))
    low = balls.groupBy("middle").agg(F.min("fp").alias("a"))
    stars = balls.join(common.merged(low), "middle").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs; component_id: the smallest doc_id reachable by links."""
    prints = common.materialize(fingerprints(docs), "fingerprints")
    nodes = common.numbers(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    joined = components(links(nodes.select("fp"), cell_limit))
    # each side of a join below is a stored table, so that the engine can split a key that holds very many rows
    groups = common.numbers(joined.join(common.merged(nodes), joined.node == nodes.fp).select("node", "component", "low"), "groups")
    names = common.numbers(groups.groupBy("component").agg(F.min("low").alias("name")), "names")
    named = groups.join(common.merged(names), "component").select(F.col("node").alias("fp"), "name")
    labels = common.numbers(nodes.join(common.merged(named), "fp", "left").select("fp", F.coalesce("name", "low").alias("component_id")), "labels")
    return prints.join(common.merged(labels), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each near-duplicate component: the row with the smallest doc_id stays (among equal
    ids the one with the smallest hash of text). A row without doc_id can't be told apart and always stays."""
    from scrubline.llm.minhash import first_of_each  # which imports this module

    rows = common.told_apart(docs)
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "doc.text"))  # components are named by rows, not ids
    return first_of_each(rows, common.numbers(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("component")), "groups"))


def op1_simhash_grid(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
