import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lustra.operators import backward_fill, fit_ordered_fill, forward_fill


def plain(rows):
    return [tuple(None if pd.isna(v) else v for v in row) for row in rows]


def check(df, order, columns, **options):
    """Both directions against pandas."""
    frame = df.toPandas().sort_values(order).reset_index(drop=True)
    for direction, filled in (("forward", frame[columns].ffill()), ("backward", frame[columns].bfill())):
        model = fit_ordered_fill(df, order, columns, direction, **options)
        found = model.transform(df).orderBy(*order).select(*columns).collect()
        assert plain(found) == plain(filled.itertuples(index=False)), direction
    return model


@pytest.fixture
def gaps(spark):
    return spark.range(5_000).selectExpr(
        "(id * 7919) % 5003 as pos",
        "case when id % 11 = 0 then cast(id as double) end as v",
        "case when id % 977 = 0 then concat('t', id) end as t",
    )


def test_matches_pandas_over_many_buckets(gaps):
    model = check(gaps, ["pos"], ["v", "t"], rows_per_bucket=50)
    assert len(model.cuts) > 50


def test_leading_and_trailing_nulls_stay(make, values):
    df = make("pos int, v int", (1, None), (2, 5), (3, None), (4, 7), (5, None))
    assert [r[1] for r in values(forward_fill(df, "pos"))] == [None, 5, 5, 7, 7]
    assert [r[1] for r in values(backward_fill(df, "pos"))] == [5, 5, 7, 7, None]


def test_one_position_with_a_third_of_the_rows_is_cut_again(spark):
    df = spark.range(6_000).selectExpr(
        "case when id % 3 = 0 then 100 else cast(id / 20 as int) end as day",
        "id as seq",
        "case when id % 53 = 0 then id end as v",
    )
    model = check(df, ["day", "seq"], ["v"], rows_per_bucket=100)
    ((position, cuts),) = model.inner_cuts
    assert position == 100.0 and len(cuts) > 15
    sizes = model._with_bucket(df).groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert sizes < 600


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_time_orders(spark, kind):
    df = spark.range(400).select(
        (F.lit(datetime.datetime(2024, 3, 31)) + F.make_dt_interval(hours=F.col("id") * (24 if kind == "date" else 1)))
        .cast(kind)
        .alias("at"),
        F.col("id").alias("seq"),
        F.when(F.col("id") % 17 == 3, F.col("id")).alias("v"),
    )
    check(df, ["at", "seq"], ["v"], rows_per_bucket=20)


def test_hot_timestamp_is_cut_by_the_rest_of_the_order(spark):
    df = spark.range(2_000).selectExpr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 2 * 0.25) as at",
        "id as seq",
        "case when id % 17 = 3 then id end as v",
    )
    model = check(df, ["at", "seq"], ["v"], rows_per_bucket=50)
    assert model.inner_cuts


def test_all_columns_by_default_and_only_those_with_gaps(gaps):
    model = fit_ordered_fill(gaps.withColumn("full", F.lit(1)), "pos")
    assert model.columns == ("v", "t")


def test_empty_table_and_bad_arguments(gaps, make):
    empty = gaps.filter("false")
    assert forward_fill(empty, "pos").count() == 0
    with pytest.raises(ValueError, match="order_by"):
        fit_ordered_fill(gaps, None)
    with pytest.raises(ValueError, match="direction"):
        fit_ordered_fill(gaps, "pos", direction="up")
    with pytest.raises(ValueError, match="first order column"):
        fit_ordered_fill(make("p string, v int", ("a", None)), "p")
