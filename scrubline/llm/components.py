"""Connected components of a link table by alternating large and small stars.

Each round is two aggregations of the links by node and two joins of the minimum back to them. The minima are stored
before they are joined, so both sides of a join are dealt by the engine and its skew-join splitting applies to a hub
with very many links; nothing is gathered per node, nor in the driver: no join broadcasts. Rounds repeat
until the links no longer change, each written to the shared scratch folder. Their number grows with the logarithm
of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scrubline.llm import common


def _minimum(links: DataFrame, node: str, other: str) -> DataFrame:
    return common.numbers(links.groupBy(node).agg(F.min(other).alias("low")), "low")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _minimum(both, "a", "b").select("a", F.least("a", "low").alias("low"))
    return both.where("b > a").join(common.merged(low), "a").select(F.col("low").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = _minimum(links, "b", "a")  # a < b: a node's smaller neighbours
    moved = links.join(common.merged(low), "b")
    return moved.select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b: long, of any order); component is the smallest node reached.

    Self-links and repeated links change nothing; a null end is no link; without links the result is empty.
    """
    spark = links.sparkSession
    ordered = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    state, last = common.numbers(ordered, "links"), None
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = sign(state)
    while now != last and now[0]:
        old, last = state.inputFiles(), now
        state = common.numbers(_small_star(_large_star(state)), "links")
        now = sign(state)
        if old:
            common.delete_scratch(spark, old[0].rsplit("/", 1)[0])
    return state.select(F.col("b").alias("node"), F.col("a").alias("component")).union(state.select(F.col("a"), F.col("a")).distinct())
