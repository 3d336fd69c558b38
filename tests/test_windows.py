import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from palisade.operators.windows import peak_window, with_previous


def naive_peaks(rows, window, distinct):
    out = {}
    for key in {k for k, _, t in rows if k is not None and t is not None}:
        mine = sorted((t, u or "") for k, u, t in rows if k == key and t is not None)
        best = None
        for t0 in sorted({t for t, _ in mine}):
            inside = [u for t, u in mine if t0 <= t <= t0 + window]
            peak = len({u for u in inside if u}) if distinct else len(inside)
            if best is None or peak > best[0]:
                best = (peak, t0, len(inside))
        out[key] = best
    return out


def spark_peaks(spark, rows, window, distinct, length):
    df = spark.createDataFrame(rows, "ip string, user string, t bigint")
    got = peak_window(df, "ip", "t", window, length, distinct="user" if distinct else None)
    return {r.ip: (r.peak, r.peak_start, r.peak_rows) for r in got.collect()}


@pytest.mark.parametrize("distinct", [False, True])
@pytest.mark.parametrize("length", [1, 7, 50, 10_000])
def test_peaks_equal_double_loop(spark, distinct, length):
    rnd = random.Random(length)
    rows = [
        (rnd.choice(["a", "a", "a", "b", "c", None]),
         rnd.choice(["u1", "u2", "u3", "u4", "", None]),
         rnd.choice([None, *range(-40, 260)]))
        for _ in range(500)
    ]
    assert spark_peaks(spark, rows, 30, distinct, length) == naive_peaks(rows, 30, distinct)


row = st.tuples(
    st.sampled_from(["a", "b"]), st.sampled_from(["x", "y", "z", None]), st.integers(-20, 20)
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(row, min_size=1, max_size=25), window=st.integers(0, 15),
       length=st.integers(1, 20), distinct=st.booleans())
def test_peaks_property(spark, rows, window, length, distinct):
    assert spark_peaks(spark, rows, window, distinct, length) == naive_peaks(rows, window, distinct)


def test_closed_end_and_earliest_start(spark):
    rows = [("a", "u", t) for t in (0, 10, 100, 110)]
    assert spark_peaks(spark, rows, 10, False, 60) == {"a": (2, 0, 2)}
    assert spark_peaks(spark, rows, 9, False, 60) == {"a": (1, 0, 1)}


def test_busy_key(spark):
    rows = [("hot", f"u{i % 97}", i // 3) for i in range(30_000)] + [("cold", "u", 5)]
    got = spark_peaks(spark, rows, 1000, False, 60)
    assert got == {"hot": (3003, 0, 3003), "cold": (1, 5, 1)}
    got = spark_peaks(spark, rows, 20, True, 60)
    assert got["hot"] == (63, 0, 63)


def test_previous(spark):
    rows = [("a", t) for t in (1, 5, 61, 300)] + [("b", 2)]
    df = spark.createDataFrame(rows, "k string, t bigint")
    got = sorted((r.k, r.t, r.previous) for r in with_previous(df, ["k"], "t", 60).collect())
    assert got == [("a", 1, None), ("a", 5, 1), ("a", 61, 5), ("a", 300, 61), ("b", 2, None)]
