"""From raw documents to shards of training text: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the folder
that the cluster shares and reads it again as the next stage's docs.

Defined results of every stage: null text counts as empty; a null doc_id is an id like any other; very long texts
are taken whole; ties and repeated rows are rows of their own, of which near_duplicates keeps one; an empty table
gives an empty table; all columns of documents pass through unchanged, whatever their names, and shards replaces
columns named shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wagerlens.llm.common import keep, table
from wagerlens.llm.decontaminate import keep_clean
from wagerlens.llm.mixing import mixed_docs
from wagerlens.llm.near_dedup import keep_one
from wagerlens.llm.quality import fit, keep_good
from wagerlens.llm.sharding import sharded_docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go; an empty text has no evidence, its score is the curve's offset."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, that of the smallest id; empty texts are copies of one another."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth go; a text without words is clean."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their target weights: documents come as often as the mix takes them, at most twice; null is a source."""
    return mixed_docs(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows get a shard of 16, of counts at most one apart, and a slot there."""
    return sharded_docs(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: SQL can express neither the classifier nor the near-duplicate classes; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
