"""Queries and pipeline over the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lustra.llm.queries_sql import SQL

FOLDER = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


@pytest.mark.parametrize("number", [*range(1, 12), 13])
def test_query_covers_its_table(spark, number):
    name = next(n for n in entry.queries() if n.startswith(f"op{number}_"))
    table = "pages" if number in (2, 3) else "documents"
    found = entry.queries()[name](spark, FOLDER)
    assert found.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == [*columns, "shard", "slot"]
    rows = found.collect()
    assert rows and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert max([r["doc_id"] for r in rows].count(r["doc_id"]) for r in rows) <= 2


def stage_ids(spark, name, docs):
    kept = dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    return sorted(r["doc_id"] for r in kept.select("doc_id").collect())


def test_near_duplicates_keep_one_of_each_group_and_all_others(spark):
    """By the components that DuckDB finds."""
    found = compare.connect(FOLDER).execute(SQL["op8_jaccard_groups"]).df()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert stage_ids(spark, "near duplicates", docs) == sorted(found[found.doc_id == found.component_id].doc_id)


def test_decontamination_keeps_exactly_the_clean_documents(spark):
    found = compare.connect(FOLDER).execute(SQL["op5_benchmark_leaks"]).df()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert stage_ids(spark, "benchmark decontamination", docs) == sorted(found[~found.contaminated].doc_id)
    assert found.contaminated.any()
