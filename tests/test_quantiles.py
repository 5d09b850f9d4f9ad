import numpy as np
import pytest
from pyspark.sql import functions as F

from lustra.functions.text import quoted
from lustra.operators import column_quantiles, group_quantiles, quantiles
from lustra.operators.modes import column_modes
from lustra.operators.quantiles import select_quantiles

PROBABILITIES = [0.0, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture
def numbers(spark):
    """Skewed values, few distinct values, one dominant value, and a constant."""
    return spark.range(20_011).selectExpr(
        "pow(10, (id * 7919 % 20011) / 2000.0) as skewed",
        "cast(id % 5 as double) as few",
        "case when id % 3 = 0 then 100.0 else cast(id as double) end as dominant",
        "1.5D as constant",
        "cast(null as double) as empty",
        "case when id % 2 = 0 then id * 1.0D end as gaps",
    )


def expected(df, column):
    found = [r[0] for r in df.select(column).collect() if r[0] is not None]
    return [None] * len(PROBABILITIES) if not found else list(np.quantile(found, PROBABILITIES))


@pytest.mark.parametrize("limit", [1_000_000, 50])
def test_columns_match_numpy_whole_and_bracketed(numbers, limit):
    columns = [c for c in numbers.columns if c != "empty"]
    found = column_quantiles(numbers, {c: quoted(c) for c in columns}, PROBABILITIES, values_per_task=limit)
    for c in columns:
        assert found[c] == pytest.approx(expected(numbers, c), rel=1e-12), c


def test_the_size_of_the_table_does_not_change_a_bit_of_the_result(numbers):
    columns = {c: quoted(c) for c in ("skewed", "few", "dominant", "gaps")}
    whole = column_quantiles(numbers, columns, PROBABILITIES)
    assert column_quantiles(numbers, columns, PROBABILITIES, values_per_task=50) == whole
    assert column_quantiles(numbers, columns, PROBABILITIES, dict.fromkeys(columns, 1)) == whole


def test_column_without_values(numbers):
    found = column_quantiles(numbers, {"empty": F.col("empty"), "few": F.col("few")}, [0.5])
    assert found == {"empty": [None], "few": [2.0]}
    assert column_quantiles(numbers, {"empty": F.col("empty")}, [0.5], {"empty": 0}) == {"empty": [None]}


def test_infinite_values(make):
    infinity = float("inf")
    df = make("v double", -infinity, -infinity, 1.0, infinity, infinity)
    found = column_quantiles(df, {"v": F.col("v")}, [0.1, 0.25, 0.5, 0.9])
    assert found == {"v": [-infinity, -infinity, 1.0, infinity]}


@pytest.fixture
def grouped(spark):
    """One group holds a third of the rows, a few rows have no group."""
    return spark.range(9_000).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('g', id % 101) end as g",
        "case when id % 97 = 0 then null else (id * 7919 % 9001) / 7.0 end as v",
    ).union(spark.sql("select cast(null as string), 1.0D"))


@pytest.mark.parametrize(("sortable", "most_groups", "broadcast"), [(5_000_000, 100, 1), (300, 100, 1 << 20), (300, 100, 1), (300, 20, 1 << 20)])
def test_groups_match_numpy(grouped, monkeypatch, sortable, most_groups, broadcast):
    """Read off running counts, or the hot group bracketed, by a broadcast or by a shuffle."""
    monkeypatch.setattr(quantiles, "MOST_GROUPS", most_groups)
    monkeypatch.setattr(quantiles, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(quantiles, "VALUES_PER_TASK", 200)
    found = {
        r["key"]: r["quantiles"]
        for r in group_quantiles(grouped, "g", F.col("v"), PROBABILITIES, sortable).collect()
    }
    groups = grouped.toPandas().dropna().groupby("g")["v"]
    assert set(found) == set(groups.groups)
    for key, part in groups:
        assert found[key] == pytest.approx(list(np.quantile(part, PROBABILITIES)), rel=1e-12)


def test_all_groups_bracketed(grouped):
    rows = grouped.select(F.col("g").alias("key"), F.col("v").alias("value"))
    found = {r["key"]: r["quantiles"] for r in select_quantiles(rows, [0.5, 0.1], values_per_task=5, sketch_size=64).collect()}
    groups = grouped.toPandas().dropna().groupby("g")["v"]
    assert set(found) == set(groups.groups)
    for key, part in groups:
        assert found[key] == pytest.approx(list(np.quantile(part, [0.5, 0.1])), rel=1e-12)


def test_missed_brackets_are_reopened(numbers, monkeypatch):
    """Coarse sketches without a margin miss; the counts show it."""
    monkeypatch.setattr(quantiles, "MARGIN", 0)
    wanted = pytest.approx(expected(numbers, "skewed"), rel=1e-12)
    rows = numbers.select(F.lit("k").alias("key"), F.col("skewed").alias("value"))
    (found,) = select_quantiles(rows, PROBABILITIES, values_per_task=50, sketch_size=8).collect()
    assert found["quantiles"] == wanted


def test_brackets_that_always_miss_end_as_whole_ranges(numbers, monkeypatch):
    merged = quantiles._merged
    wrong = F.array_repeat(F.lit(1e9), quantiles.GRID_STEPS + 1)
    monkeypatch.setattr(quantiles, "_merged", lambda *a: merged(*a).withColumn("grid", wrong))
    found = column_quantiles(numbers, {"skewed": F.col("skewed")}, [0.5], values_per_task=0)
    assert found["skewed"] == pytest.approx([float(np.quantile([r[0] for r in numbers.select("skewed").collect()], 0.5))])


def test_mode_takes_the_smallest_on_a_tie(make):
    df = make("t string, u string", ("b", None), ("a", None), ("a", None), ("b", None), (None, None))
    assert column_modes(df, {"t": F.col("t"), "u": F.col("u")}) == {"t": "a", "u": None}
    numbers = make("n double", 10.0, 9.0, 10.0, 9.0)
    assert column_modes(numbers, {"n": F.col("n")}) == {"n": 9.0}
