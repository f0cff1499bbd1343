"""Change points against plain versions, and long series."""

import numpy as np
import pytest

from cellscape.operators import series


def alike(y):
    gap = (y[:, None] - y[None]) ** 2
    mid = np.median(gap[np.triu_indices(len(y), 1)])
    out = np.exp(-np.clip(gap / (mid or 1.0), 1e-2, 1e2))
    np.fill_diagonal(out, 1.0)
    return out


def cost(g, a, b):
    return b - a - g[a:b, a:b].sum() / (b - a)


def plain_best(y, penalty, least, jump):
    g, n = alike(y), len(y)
    best = {0: (0.0, ())}
    for b in [k for k in range(0, n, jump) if k >= least] + [n]:
        v, t = min((best[t][0] + cost(g, t, b) + penalty, t) for t in best if b - t >= least)
        best[b] = v, best[t][1] + (t,)
    return [x for x in best[n][1] if x]


def plain_halves(y, penalty, least, jump):
    g, ends = alike(y), [len(y)]
    while True:
        found = []
        for a, b in zip([0, *ends], ends):
            gains = [(cost(g, a, b) - cost(g, a, k) - cost(g, k, b), k) for k in range(a, b, jump) if k - a >= least and b - k >= least]
            found.append(max(gains) if gains else (0.0, None))
        gain, k = max(found, key=lambda x: x[0])
        if k is None or gain <= penalty:
            return ends[:-1]
        ends = sorted([*ends, k])


def test_cuts_equal_plain_versions():
    rng = np.random.default_rng(1)
    for trial in range(150):
        n, least, jump = int(rng.integers(10, 80)), int(rng.choice([2, 3, 5])), int(rng.choice([1, 5]))
        y = rng.normal(0, 1, n) + np.repeat(rng.normal(0, 4, 8), 12)[:n]
        y = np.round(y) if trial % 5 == 0 else y
        penalty = float(rng.choice([0.5, 1.0, 3 * np.log(n)]))
        assert series.middle_gap(y) == pytest.approx(np.median(((y[:, None] - y) ** 2)[np.triu_indices(n, 1)]))
        assert series.pruned_cuts(y, penalty, least, jump) == plain_best(y, penalty, least, jump)
        assert series.binary_cuts(y, penalty, least, jump) == plain_halves(y, penalty, least, jump)


def test_long_series_and_missing_dates(spark):
    import tracemalloc

    rng = np.random.default_rng(2)
    y = rng.normal(0, 1, 6000) + np.repeat([0.0, 6.0, -3.0], 2000)
    tracemalloc.start()
    assert series.pruned_cuts(y, 3 * np.log(6000), 3, 5) == series.binary_cuts(y, 3 * np.log(6000), 3, 5) == [2000, 4000]
    assert tracemalloc.get_traced_memory()[1] < 60e6  # all pairs would take 288 MB
    tracemalloc.stop()
    step = [None, None, *[0.0] * 15, *[9.0] * 15]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(step)] + [(2, i, 1.0) for i in range(30)] + [(3, 0, 1.0)], "cell long, d int, y double")
    for method in ("pelt", "binseg"):
        assert {(r.cell, r.changes, r.first) for r in series.segments(df, method=method, penalty=1.0).collect()} == {(1, 1, 17), (2, 0, -1), (3, 0, -1)}
    with pytest.raises(ValueError):
        series.segments(df, method="other")
