"""The physical plans, as far as they decide whether a query scales."""

from pyspark.sql import functions as F

from lustra.operators import (
    check_not_null,
    column_info,
    fit_ordered_fill,
    group_quantiles,
    preview,
    quantiles,
    remove_duplicates,
)
from lustra.plans.catalog import QUERIES, dirty_orders, table

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_collapses_copies_before_the_shuffle(spark):
    text = plan(remove_duplicates(dirty_orders(spark, SMALL), order_by="row_ord"))
    assert text.count("HashAggregate") == 2 and "Sort" not in text
    ranked = plan(remove_duplicates(table(spark, SMALL, "documents"), ["text"], order_by="doc_id"))
    assert ranked.count("WindowGroupLimit") == 2


def test_ordered_fill_gathers_only_the_carries(spark):
    events = table(spark, SMALL, "events").select("event_id", "ts", F.nullif("value", F.lit(1.0)).alias("value"))
    sparse = events.withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    model = fit_ordered_fill(sparse, ["ts", "event_id"])
    lines = plan(model.transform(sparse)).splitlines()
    (at,) = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    # Below the only single-partition exchange is the aggregate with one row per bucket.
    assert "Aggregate" in lines[at + 1] and "_bucket" in lines[at + 1]


def test_no_query_sorts_or_ranks_a_whole_table_in_one_task(spark):
    for name in ("dedup_first", "dedup_none", "label_encode", "agg_feature_median"):
        text = plan(QUERIES[name](spark, SMALL))
        window = text.find("Window [")
        assert window == -1 or "Exchange SinglePartition" not in text[window:], name


def test_scans_read_only_what_is_needed(spark):
    lines = table(spark, SMALL, "lineitem")
    text = plan(check_not_null(lines, ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in text
    filtered = plan(column_info(lines.filter("l_quantity > 49").select("l_tax")))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in filtered


def test_preview_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(preview(table(spark, SMALL, "orders"), "o_orderkey"))


def test_sketches_are_merged_by_shard_first(spark):
    rows = table(spark, SMALL, "lineitem").selectExpr("l_linenumber as key", "l_tax as value")
    sketched = plan(quantiles._sketched(rows, [0.5], 200))
    assert "percentile" not in sketched and "SinglePartition" not in sketched
    # The exchange of the tasks' sketches is by key and shard, that of the merged ones by key.
    exchanges = [line for line in sketched.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and "shard" in exchanges[1] and "shard" not in exchanges[0]


def test_quantiles_ship_a_row_for_each_value(spark):
    rows = table(spark, SMALL, "lineitem").selectExpr("l_linenumber as key", "l_tax as value")
    brackets = quantiles._narrowed(quantiles._sketched(rows, [0.5], 200), 100, 200)
    for text in (plan(quantiles._read(rows, F.broadcast(brackets))), plan(quantiles._read_all(rows, [0.5]))):
        assert "percentile" not in text and "SinglePartition" not in text
        # Values are counted before the shuffle that deals them out by key.
        assert "partial_count(1)" in text


def test_hot_groups_are_told_apart_by_a_measured_list(spark):
    text = plan(group_quantiles(table(spark, SMALL, "lineitem"), "l_linenumber", F.col("l_tax"), [0.5], 500))
    assert "percentile" not in text and "LeftAnti" in text
