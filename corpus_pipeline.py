"""A corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes all rows its predecessor kept, and all but the last return the columns of the
documents. ``run`` writes every stage as Parquet to the shared folder and reads it again.

The pipeline has no SQL counterpart: the quality score uses hash bins, and the shards are drawn
at random. The tests compare the operators of the near-duplicate, decontamination, mixing and sharding stages with brute
force; the quality stage is tested on the share of documents that it keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lustra.llm import jaccard, leaks, mixing, quality, queries, shards
from lustra.session import materialize

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the model compares the trusted ones with all."""
    trusted = quality.trusted_ids(queries.table(spark, sf_dir, "labels"))
    model = quality.count_bins(docs, trusted)
    return quality.kept_rows(docs, trusted, model, group_col="lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id."""
    return jaccard.first_of_groups(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = leaks.find_leaks(docs, queries.table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("spans") == 0).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    weights = mixing.label_weights(queries.table(spark, sf_dir, "labels"))
    mixed = mixing.mix_sources(docs, weights).filter(F.col("times") > 0)
    copies = F.explode(F.sequence(F.lit(1), F.col("times")))
    return mixed.select("row", copies.alias("copy")).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    return shards.shuffle_shards(docs).select("row.*", "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
