"""Flow over many small tiles equals flow over one, and a plain walk."""

import random

from pyspark.sql import functions as F

from cellscape.operators import regions


def test_accumulation_over_tiles(spark):
    rng = random.Random(8)
    n = 21
    z = {(r, c): rng.randrange(40) + abs(r - 10) + c / 10 for r in range(n) for c in range(n) if (r, c) not in {(3, 3), (12, 7)}}
    dem = spark.createDataFrame([(r, c, float(v)) for (r, c), v in z.items()], "r long, c long, z double")
    flow = regions.flow_direction(regions.fill_depressions(dem, tile=8), 1.0, 1.0)
    to = {(x.r, x.c): None if x.to_r is None else (x.to_r, x.to_c) for x in flow.collect()}
    want = dict.fromkeys(to, 0)
    for k in to:
        while k is not None:
            want[k] += 1
            k = to[k]
    for tile in (3, 8, 256):
        assert {(x.r, x.c): x.acc for x in regions.flow_accumulation(flow, tile).collect()} == want
    assert sum(v for k, v in want.items() if to[k] is None) == len(z)
    assert regions.flow_accumulation(flow.limit(0)).count() == 0


def test_one_long_way_through_all_tiles(spark):
    """A snake of 900 cells, so that ways leave and enter tiles many times."""
    way = [(r, c if r % 2 == 0 else 29 - c) for r in range(30) for c in range(30)]
    rows = [(*a, *b) for a, b in zip(way, way[1:])] + [(*way[-1], None, None)]
    flow = spark.createDataFrame(rows, "r long, c long, to_r long, to_c long")
    got = {(x.r, x.c): x.acc for x in regions.flow_accumulation(flow, 4).collect()}
    assert got == {k: i + 1 for i, k in enumerate(way)}
    assert regions.summed_down(spark.createDataFrame([(0, 0, None, None, 5), (0, 1, 0, 0, 2), (0, 2, 0, 1, 1)], "r long, c long, pr long, pc long, acc long")).filter(F.col("c") == 0).first().acc == 8
