"""Trend statistics of long series: counted, not made of all pairs."""

import time
import tracemalloc

import numpy as np
import pytest

from cellscape.operators import series


def test_counts_and_slopes_equal_plain_versions():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 63, 64, 65, 200, 700):
        y = np.round(rng.normal(0, 2, n), 1)
        rises = sum(int((y[i + 1 :] > y[i]).sum()) for i in range(n))
        ties = sum(int((y[i + 1 :] == y[i]).sum()) for i in range(n))
        assert series.pair_order(y) == (rises, ties)
    for n in (4, 40, 41, 130):
        x = np.sort(rng.integers(0, 3 * n, n)).astype(float)
        y = np.round(rng.normal(0, 1, n) + 0.01 * x, 2)
        o = np.lexsort((y, x))
        x, y = x[o], y[o]
        slopes = [(y[j] - y[i]) / (x[j] - x[i]) for i in range(n) for j in range(i + 1, n) if x[j] > x[i]]
        for most in (512, 1):
            assert series.middle_slope(x, y, most) == pytest.approx(np.median(slopes), abs=1e-12)
    assert series.middle_slope(np.zeros(5), np.arange(5.0), 1) is None


def test_twenty_thousand_dates(spark):
    rng = np.random.default_rng(5)
    x = np.arange(20_000.0)
    y = 0.001 * x + rng.normal(0, 1, 20_000)
    tracemalloc.start()
    began = time.time()
    assert series.middle_slope(x, y) == pytest.approx(0.001, abs=5e-5)
    assert series._kendall(x, y) > 1e7
    assert tracemalloc.get_traced_memory()[1] < 50e6 and time.time() - began < 120
    tracemalloc.stop()


def test_cells_with_gaps_and_ties(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(6)] + [(1, 6, None)] + [(2, i, 1.0) for i in range(5)] + [(3, 0, 1.0), (3, 1, 2.0)], "cell long, t int, y double").selectExpr("cell", "date_add(date'2020-01-01', t) as d", "y")
    got = {r.cell: (r.n, r.s, r.tau) for r in series.mann_kendall(df, p_values=False).collect()}
    assert got == {1: (6, 15.0, 1.0), 2: (5, 0.0, 0.0)}
    slopes = {r.cell: r.slope for r in series.sens_slope(df).collect()}
    assert set(slopes) == {1, 2} and slopes[1] == pytest.approx(365.2425) and slopes[2] == 0.0
