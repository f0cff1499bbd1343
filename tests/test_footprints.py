"""Coverage by footprint: rings cut by a box."""

import random

import pytest
from pyspark.sql import functions as F

from cellscape.functions import catalog as fn

BOX = (0.0, 0.0, 4.0, 2.0)


def plain_area(ring, n=400):
    """Area inside BOX by counting cell centres."""
    def inside(x, y):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    step = (4.0 / n, 2.0 / n)
    return sum(inside((i + 0.5) * step[0], (j + 0.5) * step[1]) for i in range(n) for j in range(n)) * step[0] * step[1]


def test_rings_against_counted_cells(spark):
    rng = random.Random(5)
    # A ring that leaves and enters the box several times (not convex), and stars of random corners.
    rings = [[(-1, -1), (1, 3), (2, -1), (3, 3), (5, -1)], [(1, 1), (2, 1), (2, 1.5), (1, 1.5), (1, 1)], [(-9, -9), (9, -9), (9, 9), (-9, 9)], [(5, 5), (6, 5), (6, 6)]]
    import math

    for _ in range(6):
        rings.append([(2 + rng.uniform(0.5, 4) * math.cos(k * math.pi / 4), 1 + rng.uniform(0.5, 4) * math.sin(k * math.pi / 4)) for k in range(8)])
    df = spark.createDataFrame([(i, [[(float(x), float(y)) for x, y in r]]) for i, r in enumerate(rings)], "i int, rings array<array<struct<x: double, y: double>>>")
    got = dict(df.select("i", fn.covered_area(F.col("rings"), BOX)).collect())
    for i, r in enumerate(rings):
        assert got[i] == pytest.approx(plain_area([tuple(map(float, p)) for p in r]), abs=0.06), r
    assert got[1] == 0.5 and got[2] == 8.0 and got[3] == 0.0


def test_holes_missing_footprints_and_ties(spark):
    rows = [
        (1, [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)], [(1.0, 0.5), (3.0, 0.5), (3.0, 1.5), (1.0, 1.5)]]),
        (2, None),
        (3, []),
        (4, [[]]),
        (5, [[(4.0, 0.0), (5.0, 0.0), (5.0, 2.0), (4.0, 2.0)]]),
    ]
    df = spark.createDataFrame(rows, "i int, footprint array<array<struct<x: double, y: double>>>")
    got = dict(df.select("i", fn.coverage_pct(BOX, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0), F.col("footprint"))).collect())
    assert got == {1: 75.0, 2: 25.0, 3: 0.0, 4: 0.0, 5: 0.0}
