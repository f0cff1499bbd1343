"""Cells decomposed side by side give what each gives alone."""

import datetime

import numpy as np

from cellscape.operators import series


def test_rows_are_decomposed_as_alone(monkeypatch):
    rng = np.random.default_rng(5)
    for n in (1, 3, 5, 14, 40):
        y = rng.gamma(2.0, 20.0, (5, n))
        y[0], y[1, n // 2] = 3.0, 900.0
        trend, seasonal = series._decomposed(y, 7, 7, 15)
        for i in range(5):
            alone = series._decomposed(y[i : i + 1], 7, 7, 15)
            assert np.array_equal(trend[i], alone[0][0]) and np.array_equal(seasonal[i], alone[1][0])
        monkeypatch.setattr(series, "MOST_HELD", 50)
        assert np.array_equal(series._decomposed(y, 7, 7, 15)[0], trend)
        monkeypatch.undo()


def test_cells_of_many_lengths_with_gaps(spark):
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    values = {(c, k): None if c == 0 or (c + k) % 6 == 0 else float((k % 7) * 3 + c + k / 4) for c in range(6) for k in range(10 * c + 1)}
    df = spark.createDataFrame([(c, day(k), v) for (c, k), v in values.items()], "cell long, d date, y double")
    got = {(r.cell, r.d): r for r in series.stl(df, 7).collect()}
    assert set(got) == {(c, day(k)) for c, k in values}
    assert got[0, day(0)].observed == 0.0
    for (c, k), v in values.items():
        r = got[c, day(k)]
        assert v is None or r.observed == v
        assert abs(r.trend + r.seasonal + r.resid - r.observed) < 1e-9
    assert got[3, day(9)].observed == (values[3, 8] + values[3, 10]) / 2
