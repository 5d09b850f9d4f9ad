import datetime
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.operators import (
    ValidationError,
    check_custom,
    check_data_types,
    check_not_null,
    check_unique,
    check_value_ranges,
    column_info,
    describe,
    duplicate_rows,
    preview,
    quality_profile,
    raise_on_failure,
    validate,
)
from lustra.operators.checks import type_matches
from lustra.operators.profile import merge_single_rows
from lustra.operators.profile import cell_counts


@pytest.fixture
def table(make):
    return make(
        "id int, age double, name string, flag boolean",
        (1, 10.0, "a", True),
        (2, -1.0, "a", None),
        (3, None, None, False),
        (4, 200.0, None, True),
        (5, math.nan, "9", True),
    )


def brief(df):
    return [(r["column"], r["expected"], r["failed_rows"], r["status"]) for r in df.collect()]


@pytest.mark.parametrize(
    ("kind", "expected", "matches"),
    [
        (T.LongType(), "int64", True),
        (T.LongType(), "bigint", True),
        (T.LongType(), "uint8", True),
        (T.IntegerType(), "float", False),
        (T.FloatType(), "Float64", True),
        (T.StringType(), "object", True),
        (T.StringType(), "string", True),
        (T.StringType(), "str", True),
        (T.LongType(), "string", False),
        (T.TimestampNTZType(), "datetime64[ns]", True),
        (T.DateType(), "date", True),
        (T.DateType(), "datetime", False),
        (T.BooleanType(), "bool", True),
        (T.DecimalType(5, 2), "decimal(5,2)", True),
    ],
)
def test_type_names(kind, expected, matches):
    assert type_matches(kind, expected) is matches


def test_type_check_with_hints(make):
    df = make("a string, b string, c int", ("1", "x", 1), *[("2", "3", 2)] * 4)
    expected = {"a": "int", "b": "float", "c": "bool", "d": "int"}
    rows = {r["column"]: (r["found"], r["status"], r["action"]) for r in check_data_types(df, expected).collect()}
    assert rows == {
        "a": ("string", "failed", "can be coerced to numeric"),
        "b": ("string", "failed", "validation failed"),  # exactly 80 % is not enough
        "c": ("int", "failed", "can be coerced to bool"),
        "d": ("MISSING", "failed", "validation failed"),
    }


def test_ranges_are_inclusive_and_null_passes(table):
    report = check_value_ranges(
        table, {"age": {"min": 0, "max": 200}, "name": {"min": 3}, "x": {"min": 0}, "id": {}}
    )
    assert brief(report) == [
        ("age", "min 0", 1, "failed"),
        ("age", "max 200", 0, "passed"),
        ("name", "min 3", None, "failed"),
        ("x", "exists", None, "failed"),
    ]


def test_nulls_include_nan(table):
    assert brief(check_not_null(table, ["age", "id", "x"])) == [
        ("age", "no nulls", 2, "failed"),
        ("id", "no nulls", 0, "passed"),
        ("x", "exists", None, "failed"),
    ]


def test_unique_counts_rows_beyond_the_first_and_null_equals_null(table):
    assert brief(check_unique(table, ["id", "name", "age", "x"])) == [
        ("id", "unique", 0, "passed"),
        ("name", "unique", 2, "failed"),
        ("age", "unique", 1, "failed"),
        ("x", "exists", None, "failed"),
    ]
    assert brief(check_unique(table.filter("false"), ["id"])) == [("id", "unique", 0, "passed")]


def test_own_checks(table):
    def fails(df, limit):
        raise KeyError(limit)

    report = check_custom(
        table,
        [
            {"name": "column", "function": F.col("age") > 0},
            {"name": "callable", "function": lambda df: df.columns[0] == "id"},
            {"name": "falsy", "function": lambda df, n: n, "args": {"n": 0}},
            {"name": "raises", "function": fails, "args": {"limit": 3}},
            {"name": "no function"},
        ],
    )
    rows = {r["column"]: (r["failed_rows"], r["status"]) for r in report.collect()}
    assert rows == {
        "column": (1, "failed"),
        "callable": (None, "passed"),
        "falsy": (None, "failed"),
        "raises": (None, "failed"),
        "no function": (None, "failed"),
    }


SPEC = {
    "data_types": {"enabled": True, "schema": {"id": "int"}},
    "value_ranges": {"enabled": True, "ranges": {"age": {"min": 0}}},
    "not_null": {"enabled": True, "columns": ["name"]},
    "unique": {"enabled": False, "columns": ["name"]},
}


def test_suite_reports_everything_or_stops_at_the_first_failure(table):
    report = validate(table, SPEC)
    assert [(r["check"], r["status"]) for r in report.collect()] == [
        ("data_types", "passed"),
        ("value_ranges", "failed"),
        ("not_null", "failed"),
    ]
    with pytest.raises(ValidationError) as error:
        validate(table, SPEC, fail_fast=True)
    assert "value_ranges" in str(error.value) and "not_null" not in str(error.value)
    with pytest.raises(ValidationError, match="not_null"):
        raise_on_failure(report)
    assert validate(table, {"unique": {"columns": ["id"]}}).count() == 0
    raise_on_failure(validate(table, {}))


def test_quality_profile_counts_raw_cells(make):
    df = make("a int, t string", (1, "x"), (1, "x"), (None, None), (None, None), (2, " x"))
    assert quality_profile(df).first().asDict() == {
        "rows": 5,
        "columns": 2,
        "missing_cells": 4,
        "numeric_columns": 1,
        "text_columns": 1,
        "duplicate_rows": 2,
    }
    assert duplicate_rows(df.filter("false")).first()[0] == 0


def test_describe_matches_pandas(spark):
    df = spark.range(101).selectExpr(
        "id", "case when id % 4 = 0 then null else sqrt(id) end as r", "cast(id as string) as t"
    )
    expected = df.toPandas().describe()
    rows = {r["column"]: r for r in describe(df).collect()}
    assert set(rows) == {"id", "r"}
    names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "max": "max",
             "p25": "25%", "p50": "50%", "p75": "75%"}
    for column, row in rows.items():
        for ours, theirs in names.items():
            assert row[ours] == pytest.approx(expected[column][theirs])
    assert describe(df.select("t")).count() == 0


def test_column_info_and_preview(table):
    rows = [tuple(r) for r in column_info(table).collect()]
    assert rows == [("id", 5, "int"), ("age", 3, "double"), ("name", 3, "string"), ("flag", 4, "boolean")]
    assert [r["id"] for r in preview(table.orderBy(F.desc("id")), "id", 2).collect()] == [1, 2]


def test_single_rows_merge_without_a_cross_join(make):
    merged = merge_single_rows([make("a int", 1), make("b string", "x")])
    assert tuple(merged.first()) == (1, "x")
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_limits_of_another_type_are_failures(make):
    df = make("n int, s string, d date", (1, "x", datetime.date(2024, 1, 1)))
    report = check_value_ranges(
        df,
        {"n": {"min": "a", "max": 5}, "s": {"min": 3}, "d": {"min": "2024-01-02", "max": 7}},
    )
    assert brief(report) == [
        ("n", "min a", None, "failed"),
        ("n", "max 5", 0, "passed"),
        ("s", "min 3", None, "failed"),
        ("d", "min 2024-01-02", 1, "failed"),
        ("d", "max 7", None, "failed"),
    ]


def test_broken_rules_are_failures_next_to_good_ones(table):
    report = check_custom(
        table,
        [
            {"name": "unknown", "function": F.col("nope") > 1},
            {"name": "number", "function": F.col("id") + 1},
            {"name": "good", "function": F.col("id") > 0},
        ],
    )
    assert [(r["column"], r["status"]) for r in report.collect()] == [
        ("unknown", "failed"),
        ("number", "failed"),
        ("good", "passed"),
    ]


def test_rules_that_break_are_told_apart(make):
    df = make("t string, n int", ("1", 0), ("x", 1), ("3", 2))
    rules = [{"name": f"good {i}", "function": F.col("n") >= i} for i in range(5)]
    rules.insert(1, {"name": "cast", "function": F.col("t").cast("int") > 0})
    rules.insert(4, {"name": "division", "function": F.expr("6 / n > 1")})
    rules.append({"name": "truth", "function": lambda df: True})
    found = {r["column"]: (r["failed_rows"], r["status"], r["action"]) for r in check_custom(df, rules).collect()}
    assert found.pop("cast") == (None, "failed", "raised NumberFormatException: CAST_INVALID_INPUT")
    assert found.pop("division") == (None, "failed", "raised ArithmeticException: DIVIDE_BY_ZERO")
    assert found.pop("truth")[1] == "passed"
    assert [n for n, _, _ in found.values()] == [0, 1, 2, 3, 3]


def test_cell_counts_come_from_one_pass(make):
    df = make("a int, b double, m map<string,int>", (1, float("nan"), {"k": 1}), (1, None, None), (None, 2.0, {"k": 1}))
    counted = cell_counts(df)
    assert tuple(counted.first()) == (3, 4, 1)
    assert counted._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    assert tuple(cell_counts(df.filter("false")).first()) == (0, 0, 0)
