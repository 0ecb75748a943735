"""The corpus pipeline: five stages from ``documents`` to shards.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns a DataFrame that is written as Parquet and read as the next one's
``docs``. All but the last return the columns of ``docs``.

1. toxicity: a lexicon learned from the labels of the documents at hand; those
   that it predicts to be toxic go.
2. near_duplicates: one document of each group stays (the smallest id).
3. decontamination: documents that hold a benchmark item go.
4. mixing: whole documents in numbers that bring each source near its target;
   a document may be taken twice or not at all.
5. sharding: each row with its shard.

Nulls, empty and long texts, repeated rows and empty tables have the results
that the operators document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import common, op03_decontamination, op05_toxicity, op07_sharding, op08_simhash_dedup, op10_mixing
from corvane.storage import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op05_toxicity.clean(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op08_simhash_dedup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op03_decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_mixing.copies(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op07_sharding.shard(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The learned lexicon, the shingles and the components have no SQL form; tests follow them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
