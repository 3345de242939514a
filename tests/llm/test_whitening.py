"""Whitening against numpy's eigendecomposition of the covariance of all rows."""

import math

import numpy as np
import pytest

from provloom.llm.whitening import Spectrum, whiten

ROWS = "vec_id long, embedding array<double>, n string"


def frame(spark, vectors, parts=5):
    return spark.createDataFrame([(k, v, "x") for k, v in enumerate(vectors)], ROWS).repartition(parts)


def plain(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(int) + 100_000
    n, s = len(x), x.sum(0)
    center = x - s / n
    values, basis = np.linalg.eigh(center.T @ center / n)
    return x, n, s, center, values[::-1], basis[:, ::-1]


@pytest.mark.parametrize("kind", ["smooth", "equal values", "copies"])
def test_components_and_whitened_values(spark, kind):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((400, 12)) * np.exp(-np.arange(12) / 4)
    if kind == "equal values":
        vectors = np.concatenate([np.eye(12), -np.eye(12)] * 8) * 0.5
    if kind == "copies":
        vectors = np.repeat(vectors[:40], 10, 0)
    x, n, s, center, values, basis = plain(vectors)
    got = whiten(frame(spark, vectors.tolist())).collect()
    assert len(got) == 8 * n
    white = np.zeros((n, 8))
    for r in got:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and int(r["deviation"]) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r["vec_id"]], s))
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9
        assert r["identity_error"] < 1e-9
    assert np.abs(white.T @ white / n - np.eye(8)).max() < 1e-9
    if kind != "equal values":  # there any basis of the space will do
        expected = center @ basis[:, :8] / np.sqrt(values[:8])
        signs = np.sign((expected * white).sum(0))
        assert np.abs(expected * signs - white).max() < 1e-7


def test_rows_that_take_no_part(spark):
    good = [[0.1, 0.2], [0.3, -0.1], [0.0, 0.5]]
    odd = [None, [], [None, 1.0], [math.nan, 1.0], [math.inf, 0.0], [1e300, 0.0], [1.0, 2.0, 3.0]]
    got = whiten(frame(spark, good + odd)).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2} and {r["component"] for r in got} == {1, 2} and {r["n"] for r in got} == {3}


def test_no_rows_one_row_and_no_variance(spark):
    assert whiten(spark.createDataFrame([], ROWS)).count() == 0
    assert whiten(frame(spark, [[1.0, 2.0]])).count() == 0
    assert whiten(frame(spark, [[1.0, 2.0]] * 9)).count() == 0
    got = whiten(frame(spark, [[1.0, 2.0, 0.5], [1.0, 1.0, 0.5]] * 9)).collect()  # one direction alone
    assert {r["component"] for r in got} == {1} and {round(abs(r["whitened"]), 9) for r in got} == {1.0}


def test_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, [0.1, 0.2], "x"), (7, [0.4, 0.1], "x"), (7, [0.2, 0.9], "x")], ROWS)
    assert sorted(str(r["vec_id"]) for r in whiten(rows).collect()) == ["7"] * 4 + ["None"] * 2


def test_large_sums_stay_exact(spark):
    vectors = [[float(1 << 41), 0.0], [-float(1 << 41), 1.0], [0.25, 0.0]]
    x, n, s, *_ = plain(vectors)
    for r in whiten(frame(spark, vectors)).collect():
        assert int(r["deviation"]) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r["vec_id"]], s))


@pytest.mark.parametrize("seed", range(6))
def test_incremental_spectrum_is_the_scatter(seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((120, 9)) * 10.0 ** rng.integers(-3, 4, 9)
    if seed == 1:
        x[:, 3] = x[:, 2]
    if seed == 2:
        x = np.eye(9)[rng.integers(0, 9, 120)]
    halves = []
    for part in (x[:50], x[50:]):
        s, running = Spectrum.empty(9), np.zeros(9)
        for row in part:
            step = row - running
            if s.n:
                s.add_term(step, s.n / (s.n + 1))
            running, s.n = running + step / (s.n + 1), s.n + 1
        s.sums = part.sum(0).astype(object)
        halves.append(s)
    halves[0].merge(halves[1])
    scatter = np.cov(x.T, bias=True) * len(x)
    s = halves[0]
    assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - scatter).max() < 1e-11 * np.abs(scatter).max()
    assert np.abs(s.vectors.T @ s.vectors - np.eye(9)).max() < 1e-11
