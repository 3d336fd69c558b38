import math

import numpy as np
import pytest

from palisade.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x int, component string"


def covariance(kind, d, seed=1):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = {"spread": np.linspace(1, 50, d), "equal": np.full(d, 7.0), "cluster": np.r_[[9.0] * min(d, 6), np.linspace(1, 2, d)][:d],
         "low": np.r_[3.0, 2.0, np.zeros(d)][:d], "near": np.r_[5 + 1e-12, 5, 5, 5, 5 - 1e-12, np.ones(d)][:d]}[kind]
    v = q * e @ q.T
    return (v + v.T) / 2, np.sort(e)[::-1]


@pytest.mark.parametrize("kind", ["spread", "equal", "cluster", "low", "near"])
@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_pairs_of_a_covariance(kind, d):
    v, e = covariance(kind, d)
    values, vectors = whitening.leading_pairs(v)
    want = e[:4][e[:4] > 1e-9]
    assert len(values) == len(want) and np.abs(values - want).max(initial=0) < 1e-11
    assert np.abs(v @ vectors - vectors * values).max(initial=0) < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max(initial=0) < 1e-12
    for s in (0.5, 1.5, 8.0):
        assert whitening.positive_pivots(v - s * np.eye(d)) == (e > s).sum()


def rows_of(seed=2, n=300, d=9):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d)) * np.linspace(0.1, 1, d)
    rows = [(i, [float(np.float32(c)) for c in base[i % (n // 2)]], 1, "x") for i in range(n)]  # every vector twice
    rows += [(n, None, 1, "x"), (n + 1, [None] + [0.0] * (d - 1), 1, "x"), (n + 2, [float("nan")] * d, 1, "x"),
             (n + 3, [float("inf")] + [0.0] * (d - 1), 1, "x"), (n + 4, [0.5] * (d - 2), 1, "x"), (n + 5, [], 1, "x"),
             (None, [0.25] * d, 1, "x"), (3, [0.0] * d, 1, "x")]
    return rows, d


def test_against_numpy(spark):
    rows, d = rows_of()
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    whole = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * c) for c in v] + [0] * (d - len(v)) for _, v in whole], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T, bias=True)
    e, u = (a[..., ::-1] for a in np.linalg.eigh(v))
    want = {}
    for (i, _), own in zip(whole, x, strict=True):
        for k in range(4):
            want.setdefault((i, k + 1), []).append((
                int(((n * own.astype(object) - s) ** 2).sum()), (own - s / n) @ u[:, k] / e[k] ** 0.5))
    assert len(got) == 4 * len(whole)
    sign = {}
    for r in got:
        assert r["n"] == n and abs(r["explained"] / (e[r["component"] - 1] / np.trace(v)) - 1) < 1e-9 and r["identity_error"] < 1e-9
        options = want[r["vec_id"], r["component"]]
        deviation, value = min(options, key=lambda o: abs(o[0] - r["deviation"]))
        assert deviation == r["deviation"] and abs(abs(value) - abs(r["whitened"])) < 1e-9
        if abs(value) > 1e-3:
            assert sign.setdefault(r["component"], np.sign(value * r["whitened"])) == np.sign(value * r["whitened"])


def test_deviation_is_exact_or_null():
    x = np.array([[2**40, -3], [5, 2**61]], np.int64)
    sums = [2**40 + 5, 2**61 - 3]
    assert whitening.deviations(x, 2, sums) == [None, None]
    assert whitening.deviations(x[:1] >> 30, 2, [7, 1]) == [(2 * 1024 - 7) ** 2 + (2 * -1 - 1) ** 2]


def test_few_vectors(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, SCHEMA))
    assert make([]).collect() == [] and make([]).columns[0] == "vec_id"
    assert make([(1, None, 1, "x")]).collect() == []
    assert make([(1, [0.5, 0.25], 1, "x"), (2, [0.5, 0.25], 1, "x")]).collect() == []
    got = make([(1, [0.0, 1.0], 1, "x"), (2, [0.0, 3.0], 1, "x"), (3, [0.0, 3.0], 1, "x")]).collect()
    assert [(r["component"], r["n"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in got] == [(1, 2, 1.0, 1.0)] * 3
