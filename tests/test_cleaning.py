import math
import warnings

import pytest
from pyspark.sql import functions as F

from lustra.functions import id_columns, parse_number, rejects_negatives, trim_text
from lustra.operators import (
    blanks_to_null,
    clean_numeric_columns,
    drop_blank_rows,
    drop_empty_rows,
    fit_numeric_cleaner,
    numeric_detection,
    standardize_text,
    trim_columns,
)

SAMPLES = ["", " ", "a", " a ", "\t\n a b \x1f", "\xa0x　", "é ", " é", " ", "x\x1c", "~", "!"]


@pytest.mark.parametrize("text", SAMPLES)
def test_trim_strips_what_python_strips(make, text):
    df = make("t string", text)
    assert df.select(trim_text("t").alias("t")).first()["t"] == text.strip()


def test_trim_keeps_null_and_is_idempotent(make, values):
    df = make("t string, n int", (None, 1), ("  a ", 2))
    once = trim_columns(df)
    assert values(once) == [(None, 1), ("a", 2)]
    assert values(trim_columns(once)) == values(once)


def test_blank_text_and_nan_become_null(make, values):
    df = make("t string, f double", ("  ", 1.0), ("", math.nan), (" x ", None))
    assert values(blanks_to_null(df)) == [(None, None), (None, 1.0), ("x", None)]


def test_blank_rows_are_dropped_even_without_an_empty_cell(make, values):
    df = make("a string, b double", ("   ", math.nan), ("x", None), (None, 0.0))
    assert values(drop_empty_rows(blanks_to_null(df))) == [(None, 0.0), ("x", None)]


def test_both_ways_to_drop_empty_rows_agree(make, values):
    df = make(
        "a string, b double, c int",
        ("  \xa0", math.nan, None),
        ("", None, None),
        (None, None, 0),
        (" x", math.nan, None),
        (None, 0.0, None),
    )
    expected = values(drop_empty_rows(blanks_to_null(df)))
    assert values(blanks_to_null(drop_blank_rows(df))) == expected and len(expected) == 3
    assert drop_blank_rows(df, ignore=["c"]).count() == 2


def test_bookkeeping_columns_do_not_keep_an_empty_row(make):
    df = make("a string, pos int", (None, 1), ("x", 2))
    assert drop_empty_rows(df).count() == 2
    assert drop_empty_rows(df, ignore=["pos"]).count() == 1


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("1", 1.0),
        (" 1.5 ", 1.5),
        ("5.", 5.0),
        (".5", 0.5),
        ("+3", 3.0),
        ("-2e3", -2000.0),
        ("1E-2", 0.01),
        ("\xa07 ", 7.0),
        ("inf", math.inf),
        ("-Infinity", -math.inf),
        ("nan", None),
        ("NaN", None),
        ("1.0d", None),
        ("1f", None),
        ("0x10", None),
        ("0x1p3", None),
        ("1_000", None),
        ("1,000", None),
        ("$5", None),
        ("True", None),
        ("1e", None),
        (".", None),
        ("1 2", None),
        ("٣", None),
        ("", None),
        (None, None),
    ],
)
def test_number_grammar(make, text, number):
    assert make("t string", text).select(parse_number("t").alias("n")).first()["n"] == number


def test_detection_needs_more_than_half_of_all_rows(make, values):
    df = make(
        "half string, most string, date date, flag boolean",
        ("1", "1", None, True),
        ("2", "2", None, True),
        ("x", "3", None, True),
        (None, None, None, None),
    )
    assert values(numeric_detection(df)) == [("half", 4, 2, False), ("most", 4, 3, True)]
    assert fit_numeric_cleaner(df).columns == ("most",)


def test_sparse_numeric_column_is_not_detected_and_keeps_its_negatives(make, values):
    df = make("price double", -1.0, None, None)
    assert values(clean_numeric_columns(df)) == [(None,), (None,), (-1.0,)]
    dense = make("price double", -1.0, 2.0, 3.0)
    assert values(clean_numeric_columns(dense)) == [(None,), (2.0,), (3.0,)]


def test_empty_table_detects_nothing(make):
    df = make("a string", "x").filter("false")
    assert fit_numeric_cleaner(df).columns == ()
    assert numeric_detection(make("d date", None)).count() == 0


def test_named_columns_are_coerced_whatever_their_share(make, values):
    df = make("a string, b string", ("1", "x"), ("x", "y"), ("y", "z"))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        cleaned = clean_numeric_columns(df, ["a", "missing"])
    assert "missing" in str(seen[0].message)
    assert cleaned.dtypes == [("a", "double"), ("b", "string")]
    assert values(cleaned, "a") == [(None,), (None,), (1.0,)]


def test_booleans_dates_and_timestamps_are_never_coerced(spark):
    df = spark.sql(
        "select true as age, date'2020-01-01' as cost_date, timestamp'2020-01-01' as price_at"
    )
    assert clean_numeric_columns(df).dtypes == df.dtypes


def test_report_counts_coerced_and_negative_cells(make, values):
    df = make("price string, n int", ("1", 1), ("-2", 2), ("x", -3), (None, 4), ("3", 5), ("4", 6))
    assert values(fit_numeric_cleaner(df).report(df)) == [("price", 1, 1)]


def test_name_rules():
    assert [n for n in ("discount", "page_no", "PRICE", "total") if rejects_negatives(n)] == [
        "discount",
        "page_no",
        "PRICE",
    ]
    names = ["id", "ID", "Id", "iD", "uuid", "GUID", "user_id", "User_ID", "idx", "paid"]
    assert id_columns(names) == ["id", "ID", "Id", "uuid", "GUID", "user_id", "User_ID"]


def test_standardize_lowers_text_and_leaves_the_rest(make, values):
    df = make("a string, b int, c string", (" Ab\xa0", 1, " Keep "), (None, 2, "x"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        result = standardize_text(df, ["a", "b", "missing"])
    assert values(result) == [(None, 2, "x"), ("ab", 1, " Keep ")]


def test_column_names_with_dots_and_spaces(make, values):
    df = make("`unit.price` string, `a b` string", ("-1", " x "), ("2", "  "), ("3", "y"))
    cleaned = clean_numeric_columns(blanks_to_null(df))
    assert cleaned.columns == ["unit.price", "a b"]
    assert values(cleaned.select(F.col("`unit.price`"))) == [(None,), (2.0,), (3.0,)]
