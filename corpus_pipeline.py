"""A corpus pipeline: each stage applies one operator of ``tamarack.llm``.

Rows of ``documents`` go through language ID (texts in no learned language
go), near-duplicate removal (one document of each group stays, by SimHash
and, for texts that only a block tells apart, by their shingles), benchmark
decontamination (documents that hold an item go), mixing to target weights
(documents are left out, taken once or taken twice, in the order of their
positions in the training) and sharding (which adds ``shard`` and ``slot``).
SQL can't express the stages; ``tests/llm`` hold them against brute-force
versions.  Null texts go in the first stage; repeated rows are one document to
the second; columns of any name stay; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm.common import drop, materialise, scratch, table
from tamarack.llm.decontam import drop_contaminated
from tamarack.llm.langid import keep_known, learn
from tamarack.llm.mixing import take
from tamarack.llm.neardup import DISTANCE, keep_one
from tamarack.llm.sharding import shard


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs, learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, distance=DISTANCE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch() as kept:
            docs = materialise(stage(spark, before, sf_dir), name)
            kept.append(docs)
        drop(before)
    return docs
