"""Corpus pipeline: from raw documents to packed sequences.

STAGES are applied in order; each takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and but
for the last returns the columns of documents. The rules of each stage are those of its operator's query, but for
near_dedup: it goes by the similarity of texts, which fingerprints of 64 bits can't tell (see the README). Op1's grid gives
it candidates, as MinHash bands do; op1's query goes by fingerprints alone.

Defined results, for all stages: a null text is kept or dropped like an empty one and never fails; repeated rows are
judged one by one, but for near_dedup, where they are copies; rows without doc_id always survive near_dedup; of ties
near_dedup keeps the smallest doc_id; texts of any length are handled whole; an empty table gives no rows; further
columns, of whatever name, are handed on.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrubline.llm import common, decontam, minhash, packing, pii, quality_rules


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


#: Less than packing alone takes: here executors also hold what earlier stages have left in the JVM.
PACKING_MEMO_WORDS = 300_000


@_in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or fertility rules reject go."""
    return quality_rules.keep(docs, quality_rules.production_rules())


@_in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a Jaccard similarity of 0.8 or more over shingles of five words."""
    return minhash.keep_one(docs)


@_in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark text go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_in_small_batches
def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by pseudonyms under the session's key (pii.KEY_SETTING)."""
    return pii.pseudonymize(docs, pii.session_key(spark))


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack_documents(docs, packing.production_tokenizer(), memo_words=PACKING_MEMO_WORDS)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("pii", pseudonymize),
    ("best-fit packing", pack),
]

#: No SQL runs tokenizers, SimHash or Feistel networks; tests/llm/test_pipeline.py holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs, f"stage{k}")
    return docs
