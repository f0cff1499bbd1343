"""Distances on long columns: against brute force, and no frame that is read anew for each row."""

import math
import random

from cellscape.operators import regions


def test_distances_equal_brute_force_in_running_frames(spark):
    rng = random.Random(2)
    cells = [(r, c) for r in range(60) for c in range(5)] + [(100, c) for c in range(5)]
    hit = rng.sample(cells, 9)
    grid, mask = (spark.createDataFrame(x, "r long, c long") for x in (cells, hit))
    out = regions.distance_to_mask(grid, mask, 8.0, 10.0)
    got = {(x.r, x.c): x.value for x in out.collect()}
    assert set(got) == set(cells)
    for r, c in cells:
        assert abs(got[r, c] - min(math.hypot((r - a) * 10.0, (c - b) * 8.0) for a, b in hit)) < 1e-9
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert all(x.value is None for x in regions.distance_to_mask(grid, mask.limit(0), 8.0, 10.0).collect())
