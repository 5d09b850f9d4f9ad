"""Whitening against numpy."""

import math

import numpy as np
import pytest

from lustra.llm import whitening


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, "z", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "key long, vec array<float>, block string, n int").repartition(3)


def vectors(n, width, seed=3):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(n, width)) @ np.diag(np.linspace(3, 1, width)) + 5).astype(np.float32).tolist()


def expected(rows, components):
    x = np.floor(64 * np.array(rows, np.float64)).astype(np.int64) + 1_000_000
    d = len(x) * x - x.sum(axis=0)
    centred = d / len(x)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    values, axes = values[::-1], axes[:, ::-1][:, :components]
    return centred @ axes / np.sqrt(values[:components]), (d * d).sum(axis=1), values[:components] / values.sum()


@pytest.mark.parametrize("block_bytes", [1 << 20, 8 * 6 * 7])
def test_same_as_numpy(spark, block_bytes):
    rows = vectors(60, 6)
    found = whitening.whiten(table(spark, rows), "key", "vec", components=4, block_bytes=block_bytes)
    whitened, deviations, explained = expected(rows, 4)
    got = found.rows.collect()
    assert len(got) == 60 * 4 and {r["n"] for r in got} == {60}
    matrix = np.zeros((60, 4))
    for r in got:
        matrix[r["id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviations[r["id"]]
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
    signs = np.sign((matrix * whitened).sum(axis=0))
    assert np.abs(matrix - whitened * signs).max() < 1e-9
    covariance = matrix.T @ matrix / 60
    assert np.abs(covariance - np.eye(4)).max() < 1e-9


def test_unusable_rows_are_left_out(spark):
    good = vectors(20, 3)
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    ids = [*range(20), *range(100, 106)]
    got = whitening.whiten(table(spark, good + bad, ids), "key", "vec").rows.collect()
    assert {r["id"] for r in got} == set(range(20)) and {r["n"] for r in got} == {20}
    assert {r["component"] for r in got} == {1, 2, 3}


def test_repeated_rows_and_null_ids_count(spark):
    rows = vectors(10, 2)
    got = whitening.whiten(table(spark, rows + rows[:5], [None, *range(1, 10), *range(5)]), "key", "vec").rows.collect()
    assert len(got) == 15 * 2 and {r["n"] for r in got} == {15}
    assert sum(r["id"] is None for r in got) == 2


def test_components_without_variance_are_left_out(spark):
    rows = [[a, 2.0, a] for a in (1.0, 2.0, 4.0)]
    got = whitening.whiten(table(spark, rows), "key", "vec").rows.collect()
    assert {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-9 for r in got)


@pytest.mark.parametrize("rows", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 4])
def test_nothing_to_whiten(spark, rows):
    found = whitening.whiten(table(spark, rows), "key", "vec")
    assert found.rows.collect() == [] and found.identity_error == 0.0
    assert found.rows.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long_is_null():
    exact = whitening._deviations(np.array([[3_000_000_000, 1], [4_000_000_000, 0], [0, 2]]))
    assert exact == [9_000_000_000_000_000_001, None, 4]
