import warnings

import pytest

from lustra.operators import (
    drop_missing,
    fit_fill,
    fit_invalid_zeros,
    handle_invalid_zeros,
    handle_missing_values,
)
from lustra.operators.lookup import build_lookup


@pytest.fixture
def houses(make):
    return make(
        "row int, area string, size double",
        (1, "a", 0.0),
        (2, "a", 10.0),
        (3, "a", 20.0),
        (4, "b", 0.0),
        (5, "b", None),
        (6, None, 0.0),
        (7, "c", 60.0),
    )


def sizes(df, values):
    return {r[0]: r[1] for r in values(df, "row", "size")}


def test_group_mean_with_fallback_to_the_overall_mean(houses, values):
    rule = {"size": {"strategy": "neighborhood_mean", "group_by": "area"}}
    found = sizes(handle_invalid_zeros(houses, rule), values)
    assert found == {1: 15.0, 2: 10.0, 3: 20.0, 4: 30.0, 5: None, 6: 30.0, 7: 60.0}


def test_group_column_absent_means_overall_mean(houses, values):
    rule = {"size": {"strategy": "neighborhood_mean", "group_by": "district"}}
    assert sizes(handle_invalid_zeros(houses, rule), values)[1] == 30.0
    only_zeros = houses.filter("size = 0")
    assert set(sizes(handle_invalid_zeros(only_zeros, rule), values).values()) == {0.0}


def test_without_any_mean_the_zero_becomes_null(houses, values):
    rule = {"size": {"strategy": "neighborhood_mean", "group_by": "area"}}
    found = sizes(handle_invalid_zeros(houses.filter("size = 0"), rule), values)
    assert set(found.values()) == {None}


@pytest.mark.parametrize(
    ("strategy", "value"), [("median", 20.0), ("mode", 10.0), ("null", None), ("anything", None)]
)
def test_replacement_strategies(houses, values, strategy, value):
    found = sizes(handle_invalid_zeros(houses, {"size": {"strategy": strategy}}), values)
    assert found[1] == found[4] == found[6] == value
    assert found[2] == 10.0


def test_drop_is_the_default_and_keeps_null(houses, values):
    assert sorted(sizes(handle_invalid_zeros(houses, {"size": {}}), values)) == [2, 3, 5, 7]


def test_flag_is_true_for_null_and_unparseable(make, values):
    df = make("row int, n string", (1, "0"), (2, "0.0"), (3, "x"), (4, None), (5, "7"))
    flagged = handle_invalid_zeros(df, {"n": {"strategy": "null"}}, flag_invalid=True)
    assert dict(values(flagged, "row", "is_valid_n")) == {
        1: False, 2: False, 3: True, 4: True, 5: True,
    }
    assert dict(flagged.dtypes)["n"] == "double"


def test_rules_run_in_order_on_what_is_left(make, values):
    df = make("a double, b double", (0.0, 100.0), (1.0, 0.0), (1.0, 4.0))
    rules = {"a": {"strategy": "drop"}, "b": {"strategy": "median"}}
    assert values(handle_invalid_zeros(df, rules)) == [(1.0, 4.0), (1.0, 4.0)]


def test_fitted_repair_applies_to_another_table(houses, make, values):
    rule = {"size": {"strategy": "neighborhood_mean", "group_by": "area"}}
    model = fit_invalid_zeros(houses, rule)
    other = make("row int, area string, size double", (1, "a", 0.0), (2, "new", 0.0))
    assert sizes(model.transform(other), values) == {1: 15.0, 2: 30.0}


@pytest.mark.parametrize("limit", [0, 10**9])
def test_lookup_by_shuffle_equals_lookup_by_broadcast(spark, values, limit):
    """A key with a third of the rows, rows without a key, and unknown keys."""
    df = spark.range(6_000).selectExpr(
        "id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('k', id) end as k"
    )
    table = df.filter("k is not null").groupBy("k").count().selectExpr(
        "k", "count as n", "count as _group_rows"
    )
    lookup = build_lookup(table, "k", broadcast_bytes=limit)
    assert lookup.broadcastable == (limit > 0)
    assert lookup.hot_groups == (0 if limit else 1)
    more = df.unionByName(spark.sql("select -1L as id, 'unknown' as k"))
    attached = lookup.attach(more)
    assert attached.columns == ["id", "k", "n"]
    rows = values(attached)
    assert len(rows) == 6_001
    for _, key, n in rows:
        assert n == (None if key in (None, "unknown") else 2_000 if key == "hot" else 1)


@pytest.fixture
def people(make):
    return make(
        "name string, age string, score int, flag boolean, day date",
        ("b", "10", 1, True, None),
        ("a", "20", 2, None, None),
        (None, "x", None, False, None),
        ("b", None, 4, False, None),
        ("a", "40", 9, None, None),
    )


def test_drop_needs_every_chosen_column(people):
    assert drop_missing(people).count() == 0
    assert drop_missing(people, ["name", "age"]).count() == 3
    assert drop_missing(people.drop("day")).count() == 1


def test_median_and_mode(people, values):
    filled = handle_missing_values(people, "fill")
    assert dict(filled.dtypes) == {
        "name": "string", "age": "double", "score": "double", "flag": "boolean", "day": "date",
    }
    rows = values(filled)
    assert [r[0] for r in rows] == ["a", "a", "a", "b", "b"]
    assert sorted(r[1] for r in rows) == [10.0, 20.0, 20.0, 20.0, 40.0]
    assert sorted(r[2] for r in rows) == [1.0, 2.0, 3.0, 4.0, 9.0]
    assert sorted(r[3] for r in rows) == [False, False, False, False, True]
    assert {r[4] for r in rows} == {None}


def test_numeric_constant_leaves_text_to_its_mode(people, values):
    filled = handle_missing_values(people, "fill", fill_value=-1)
    assert sorted(r[0] for r in values(filled, "score")) == [-1, 1, 2, 4, 9]
    assert dict(filled.dtypes)["score"] == "int"
    assert sorted(r[0] for r in values(filled, "age")) == [-1.0, -1.0, 10.0, 20.0, 40.0]
    assert values(filled, "name")[2] == ("a",)


def test_text_constant_leaves_numbers_to_their_median(people, values):
    filled = handle_missing_values(people, "fill", fill_value="?")
    assert ("?",) in values(filled, "name")
    assert 3.0 in [r[0] for r in values(filled, "score")]


def test_empty_columns(make, values):
    df = make("t string, n double", (None, None), (None, None))
    assert values(handle_missing_values(df, "fill")) == [("Unknown", 0.0), ("Unknown", 0.0)]


def test_whole_columns_keep_their_type(make):
    df = make("key bigint, n double", (2**60 + 1, 1.0), (3, None))
    filled = handle_missing_values(df, "fill")
    assert filled.dtypes == [("key", "bigint"), ("n", "double")]
    assert filled.first()["key"] == 2**60 + 1


def test_fill_leaves_no_nulls_and_reports_its_counts(people):
    chosen = people.drop("day")
    model = fit_fill(chosen)
    filled = model.transform(chosen)
    assert filled.na.drop().count() == 5
    assert model.missing_counts == {"name": 1, "age": 2, "score": 1, "flag": 2}


def test_unknown_columns_are_skipped_and_unknown_strategies_are_not(people):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert handle_missing_values(people, "drop", columns=["name", "nope"]).count() == 4
    assert "nope" in str(seen[0].message)
    with pytest.raises(ValueError, match="strategy"):
        handle_missing_values(people, "guess")


def test_ordered_strategies_go_through_the_same_door(make, values):
    df = make("pos int, v int", (1, 5), (2, None))
    assert values(handle_missing_values(df, "forward_fill", order_by="pos")) == [(1, 5), (2, 5)]
