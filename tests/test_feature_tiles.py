"""Features over many small tiles equal those over one."""

import numpy as np
from pyspark.sql import functions as F

from cellscape.operators import learning, stacks


def test_tiles_do_not_show(spark):
    rng = np.random.default_rng(7)
    v = rng.random((45, 70, 3)).round(3)
    cells = spark.createDataFrame([(k, r + 5, c - 3, *map(float, v[r, c] * (1 if k == "a" else 0.5))) for k in "ab" for r in range(45) for c in range(70)], "k string, r long, c long, red double, green double, blue double")
    one, many = (learning.rgb_features_33(cells, ["k"], tile).toPandas().sort_values(["k", "r", "c"]).reset_index(drop=True) for tile in (256, 20))
    assert len(one) == len(many) == 2 * 45 * 70 and list(one.columns) == list(many.columns)
    assert np.allclose(one.drop(columns="k").to_numpy(float), many.drop(columns="k").to_numpy(float), atol=1e-7)
    # Wrapped neighbours of a corner, by hand.
    b = v.mean(axis=2)
    around = [b[i % 45, j % 70] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    patch = stacks.Patch(stacks.haloed(cells.filter("k = 'a'"), ("red", "green", "blue"), [], 256).toPandas().query("tr == 0 and tc == 0"), ("red", "green", "blue"))
    got = patch.pattern(lambda p: p[["red", "green", "blue"]].to_numpy().mean(axis=1))
    assert got[0, 3] == sum(b[i % 45, j % 70] <= b[0, 3] for i in (-1, 0, 1) for j in (2, 3, 4) if (i, j) != (0, 3)) and len(around) == 8
    plan = learning.rgb_features_33(cells, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange ") <= 4


def test_one_row_and_one_cell(spark):
    for n in (1, 9):
        cells = spark.range(n).selectExpr("0L as r", "id as c", "id / 10D as red", "0.2D as green", "0.1D as blue")
        got = learning.rgb_features(cells).toPandas()
        assert len(got) == n and np.isfinite(got.to_numpy(float)).all()
    assert learning.rgb_features(cells.filter(F.lit(False))).count() == 0
