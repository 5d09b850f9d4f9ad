import datetime
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lustra.operators import (
    aggregate_features,
    datetime_features,
    encode_categorical,
    fit_labels,
    fit_onehot,
    fit_outliers,
    fit_scaler,
    normalize,
    remove_outliers,
    select_features,
)
from lustra.operators.features import AGGREGATE_NAMES

# ------------------------------------------------------------ outliers


def test_iqr_cap_keeps_every_row_and_null(make, values):
    df = make("n int", 1, 2, 3, 4, 100, None)
    capped = remove_outliers(df, ["n"], cap=True)
    assert capped.dtypes == [("n", "double")]
    assert sorted(r[0] for r in values(capped) if r[0] is not None) == [1, 2, 3, 4, 7]
    assert capped.count() == 6


def test_iqr_bounds_are_inclusive_and_removal_keeps_null(make, values):
    df = make("n double", 1.0, 2.0, 3.0, 4.0, 7.0, 100.0, None)
    model = fit_outliers(df, ["n"])
    (bounds,) = model.bounds
    kept = [r[0] for r in values(model.transform(df))]
    assert None in kept and 100.0 not in kept
    edge = make("n double", bounds.low, bounds.high, bounds.high + 0.01)
    assert model.transform(edge).count() == 2


def test_no_spread_or_one_value_is_left_alone(make):
    constant = make("n double", 5.0, 5.0, 5.0, 5.0, 99.0)
    assert remove_outliers(constant, ["n"]).count() == 5
    single = make("n double", 5.0, None)
    for method in ("iqr", "zscore"):
        assert remove_outliers(single, ["n"], method).count() == 2


def test_zscore_threshold_is_three_whatever_the_factor(make, values):
    rows = [10.0, 11.0] * 10 + [60.0]
    df = make("n double", *rows)
    mean, std = np.mean(rows), np.std(rows, ddof=1)
    assert abs((60 - mean) / std) >= 3
    assert remove_outliers(df, ["n"], "zscore", factor=100).count() == 20
    capped = remove_outliers(df, ["n"], "zscore", cap=True)
    assert max(r[0] for r in values(capped)) == pytest.approx(mean + 3 * std)


def test_removal_is_sequential_unless_asked_otherwise(make):
    rows = [(float(i), float(i)) for i in range(10)] + [(1000.0, 5.0)] * 2 + [(5.0, 21.0)]
    df = make("a double, b double", *rows)
    step = fit_outliers(df, ["a"]).transform(df)
    assert fit_outliers(df, ["a", "b"]).bounds[1] == fit_outliers(step, ["b"]).bounds[0]
    together = fit_outliers(df, ["a", "b"], simultaneous=True)
    assert together.bounds[1] == fit_outliers(df, ["b"]).bounds[0]


def test_text_column_stays_text_when_capped(make, values):
    df = make("t string", "1", "2", "3", "4", "100", "word")
    capped = remove_outliers(df, ["t"], cap=True)
    assert capped.dtypes == [("t", "string")]
    assert ("7.0",) in values(capped) and ("word",) in values(capped)


def test_every_numeric_column_by_default(make):
    df = make("id int, t string, n double, flag boolean", (1, "1", 1.0, True), (2, "2", 2.0, True))
    assert [b.column for b in fit_outliers(df).bounds] == ["id", "n"]
    with pytest.raises(ValueError, match="method"):
        fit_outliers(df, method="mad")


def test_capping_spares_whole_columns_without_outliers(make):
    df = make("id bigint, n int", *[(2**60 + i, i) for i in range(9)], (2**60 + 9, 500))
    capped = remove_outliers(df, None, cap=True)
    assert capped.dtypes == [("id", "bigint"), ("n", "double")]
    assert capped.agg(F.max("id")).first()[0] == 2**60 + 9


def test_report_counts_values_beyond_the_bounds(make, values):
    df = make("n int", 1, 2, 3, 4, 100, -100, None)
    assert values(fit_outliers(df, cap=True).report(df)) == [("n", 2)]


# ------------------------------------------------------------ scaling


def test_standard_and_minmax(make, values):
    df = make("n int, c double, t string", (1, 7.1, "x"), (2, 7.1, "y"), (3, 7.1, None))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        standard = normalize(df, ["n", "c", "t", "missing"])
    step = 1 / np.std([1, 2, 3])
    assert [r[0] for r in values(standard, "n")] == pytest.approx([-step, 0.0, step])
    assert {r[0] for r in values(standard, "c")} == {0.0}
    assert dict(standard.dtypes)["t"] == "string"
    minmax = normalize(df, ["n", "c"], "minmax")
    assert [r[0] for r in values(minmax, "n")] == [0.0, 0.5, 1.0]
    assert {r[0] for r in values(minmax, "c")} == {0.0}


def test_scaler_keeps_null_skips_small_types_and_applies_elsewhere(make, values):
    df = make("n double, s smallint, e double", (1.0, 1, None), (None, 2, None), (3.0, 3, None))
    scaler = fit_scaler(df, ["n", "s", "e"], "minmax")
    assert set(scaler.parameters) == {"n", "e"}
    assert values(scaler.transform(df), "n", "e") == [(None, None), (0.0, None), (1.0, None)]
    assert values(scaler.transform(make("n double", 5.0))) == [(2.0,)]
    with pytest.raises(ValueError, match="method"):
        fit_scaler(df, ["n"], "robust")


# ------------------------------------------------------------ encoding


def test_labels_follow_text_order_with_null_as_a_class(make, values):
    df = make("t string, n int", ("z", 10), ("b", 9), (None, 10), ("nb", None))
    coded = encode_categorical(df, ["t", "n"])
    # Text order: b < nan < nb < z, and "10" < "9" < "nan".
    assert values(coded) == [(0, 1), (1, 0), (2, 2), (3, 0)]
    assert dict(coded.dtypes) == {"t": "bigint", "n": "bigint"}


def test_labels_of_many_classes_match_a_sort(spark):
    df = spark.range(5_000).selectExpr("concat('v', id * 7919 % 3001) as t")
    found = df.withColumn("raw", F.col("t"))
    coded = fit_labels(df, ["t"]).transform(found).distinct().collect()
    expected = {text: i for i, text in enumerate(sorted({r["raw"] for r in coded}))}
    assert {r["raw"]: r["t"] for r in coded} == expected and len(expected) == 3001


def test_unseen_label_is_null(make, values):
    model = fit_labels(make("t string", "a", "b"), ["t"])
    assert values(model.transform(make("t string", "b", "c"))) == [(None,), (1,)]


def test_onehot(make, values):
    df = make("t string, n int", ("b", 1), ("a", 2), (None, 3))
    coded = encode_categorical(df, ["t"], "onehot")
    assert coded.columns == ["n", "t_a", "t_b"]
    assert values(coded) == [(1, False, True), (2, True, False), (3, False, False)]
    with pytest.raises(ValueError, match="categories"):
        fit_onehot(df, ["n"], max_categories=2)
    with pytest.raises(ValueError, match="exist"):
        encode_categorical(df.withColumn("t_a", F.lit(1)), ["t"], "onehot")
    with pytest.raises(ValueError, match="method"):
        encode_categorical(df, ["t"], "hash")


# ------------------------------------------------------------ selection and dates


def test_selection(make):
    df = make("a int, b int, c int", (1, 2, 3))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert select_features(df, ["c", "x", "a"]).columns == ["c", "a"]
    assert "'x'" in str(seen[0].message)
    assert select_features(df, ["b", "x"], "drop").columns == ["a", "c"]
    with pytest.raises(ValueError, match="action"):
        select_features(df, ["a"], "sort")


def test_date_parts_with_monday_as_zero(make, values):
    df = make("d string", "2024-01-01", " 2024-02-29 23:59:59", "never", None)
    found = datetime_features(df, ["d"])
    assert found.columns == ["d", "d_year", "d_month", "d_day", "d_dayofweek"]
    assert values(found)[2:] == [
        (datetime.datetime(2024, 1, 1), 2024, 1, 1, 0),
        (datetime.datetime(2024, 2, 29, 23, 59, 59), 2024, 2, 29, 3),
    ]
    assert values(found)[:2] == [(None,) * 5] * 2


def test_all_or_nothing_and_formats(make, values):
    df = make("d string, e string", ("01/02/2024", "x"), (None, "2024-01-01"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        kept = datetime_features(df, ["d", "e"], fmt="dd/MM/yyyy", all_or_nothing=True)
    assert "d_month" in kept.columns and "e_month" not in kept.columns
    assert values(kept, "d_month") == [(None,), (2,)]


# ------------------------------------------------------------ group features


@pytest.mark.parametrize("name", [n for n in AGGREGATE_NAMES])
def test_group_aggregates_match_pandas(spark, name):
    """Groups with gaps, without any value, with one value, constant, and a third of the rows."""
    frame = pd.DataFrame({"pos": range(120)})
    frame["g"] = ["hot" if i % 3 == 0 else f"g{i % 7}" for i in frame.pos]
    frame.loc[frame.pos % 31 == 5, "g"] = None
    frame["v"] = (frame.pos * 37 % 101) / 8.0
    frame.loc[(frame.g == "g1") | (frame.pos % 11 == 4), "v"] = np.nan
    frame.loc[(frame.g == "g2") & (frame.pos > 20), "v"] = np.nan
    frame.loc[(frame.g == "g3") & frame.v.notna(), "v"] = 0.0
    rows = [
        (int(p), g if isinstance(g, str) else None, None if np.isnan(v) else float(v))
        for p, g, v in frame.itertuples(index=False)
    ]
    df = spark.createDataFrame(rows, "pos int, g string, v double")
    rule = {"f": {"group_by": "g", "column": "v", "function": name}}
    found = aggregate_features(df, rule, order_by="pos").orderBy("pos").collect()

    table = frame.groupby("g")["v"].agg(name)
    for row in found:
        value = row[f"f_{name}"]
        if row["g"] is None:
            assert value is None
        elif pd.isna(table[row["g"]]):
            assert value is None
        else:
            assert value == pytest.approx(table[row["g"]], abs=1e-9), row["g"]


def test_features_share_a_pass_and_may_build_on_each_other(make, values):
    df = make("g string, h int, v int", ("a", 1, 1), ("a", 2, 3), ("b", 1, 10), (None, 1, 99))
    rules = {
        "v": {"group_by": "g", "column": "v"},
        "n": {"group_by": "g", "column": "v", "function": "size"},
        "top": {"group_by": "h", "column": "v_mean", "function": "max"},
    }
    found = aggregate_features(df, rules)
    assert found.columns == ["g", "h", "v", "v_mean", "n_size", "top_max"]
    assert values(found) == [
        (None, 1, 99, None, None, 10.0),
        ("a", 1, 1, 2.0, 2, 10.0),
        ("a", 2, 3, 2.0, 2, 2.0),
        ("b", 1, 10, 10.0, 1, 10.0),
    ]


def test_feature_on_the_group_column_itself(make, values):
    rules = {"f": {"group_by": "g", "column": "g", "function": "count"}}
    assert values(aggregate_features(make("g int", 1, 1, 2), rules)) == [(1, 2), (1, 2), (2, 1)]


def test_bad_feature_rules(make):
    df = make("g int, v int", (1, 2))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        skipped = {"a": {"group_by": "g"}, "b": {"group_by": "x", "column": "v"}}
        assert aggregate_features(df, skipped).columns == ["g", "v"]
    assert len(seen) == 2
    with pytest.raises(ValueError, match="function"):
        aggregate_features(df, {"a": {"group_by": "g", "column": "v", "function": "cumsum"}})
    taken = df.withColumn("a_mean", F.lit(1))
    with pytest.raises(ValueError, match="exists"):
        aggregate_features(taken, {"a": {"group_by": "g", "column": "v"}})
    with pytest.raises(ValueError, match="order_by"):
        aggregate_features(df, {"a": {"group_by": "g", "column": "v", "function": "first"}})


@pytest.mark.parametrize("method", ["standard", "minmax"])
def test_scaling_refuses_infinite_values(make, method):
    df = make("v double", 1.0, 2.0, float("inf"))
    with pytest.raises(ValueError, match="infinite"):
        normalize(df, ["v"], method)


@pytest.mark.parametrize("cap", [False, True])
def test_infinite_values_leave_a_column_alone(make, values, cap):
    df = make("v double", *range_with_infinity())
    assert values(remove_outliers(df, ["v"], "zscore", cap=cap)) == values(df)


def range_with_infinity():
    return [*map(float, range(30)), float("inf")]


def test_features_of_unfit_types_are_skipped(make, values):
    df = make("g int, t string, v int", (1, "x", 2), (1, None, 4))
    rules = {
        "a": {"group_by": "g", "column": "t", "function": "mean"},
        "b": {"group_by": "g", "column": "t", "function": "any"},
        "c": {"group_by": "g", "column": "t", "function": "max"},
        "d": {"group_by": "g", "column": "c_max", "function": "median"},
        "e": {"group_by": "g", "column": "v", "function": "mean"},
    }
    with pytest.warns(UserWarning, match="no median of string"):
        found = aggregate_features(df, rules)
    assert found.columns == ["g", "t", "v", "c_max", "e_mean"]
    assert values(found, "v", "c_max", "e_mean") == [(2, "x", 3.0), (4, "x", 3.0)]


def test_onehot_has_no_bound_of_its_own(spark):
    df = spark.range(1100).withColumnRenamed("id", "n")
    assert len(fit_onehot(df, ["n"]).categories["n"]) == 1100
