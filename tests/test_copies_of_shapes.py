"""Joins of layers in which many rows have the same shape."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellscape.operators import leaves, vector

BOXES = "id long, west double, south double, east double, north double"


@pytest.fixture(scope="module")
def copies():
    """Two layers of boxes of few shapes; rows without a key, equal keys, and a box that meets none."""
    rng = random.Random(12)
    layers = []
    for n in (400, 300):
        shapes = [(x, y, x + 0.4, y + 0.3) for x, y in ((rng.randint(0, 30) / 10, rng.randint(0, 30) / 10) for _ in range(12))]
        layers.append([(i, *rng.choice(shapes)) for i in range(n)] + [(None, *shapes[0]), (None, *shapes[0]), (7, *shapes[1]), (7, 90.0, 90.0, 91.0, 91.0), (None, 80.0, 80.0, 81.0, 81.0)])
    layers[1] = [(b[0], *(v + 300 for v in b[1:])) if b[1] > 50 else b for b in layers[1]]
    return layers


def met(a, b):
    return a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]


def test_every_pair_of_copies_once(spark, copies):
    left, right = copies
    want = Counter((a[0], b[0]) for a in left for b in right if met(a, b))
    a, b = (spark.createDataFrame(rows, BOXES) for rows in copies)
    for most in (100_000, 20):
        got = vector.boxes_that_meet(a, b, 0.5, most)
        assert Counter(map(tuple, got.collect())) == want
    # Copies are tested together, and the pairs are not left to the few tasks that read the layers.
    sides = [leaves.boxed(df.select(F.col("id").alias(k), "west", "south", "east", "north"), *map(F.col, ("west", "south", "east", "north"))) for df, k in ((a, "l"), (b, "r"))]
    assert vector._gathered_join(sides, ("l", "r"), [list(leaves.BOX)] * 2, 0.5, 100_000).count() < sum(want.values()) / 100
    assert vector.boxes_that_meet(a.coalesce(1), b.coalesce(1)).rdd.getNumPartitions() >= 16


def test_features_without_a_partner_are_rows(spark, copies):
    """With equal and missing keys, and a feature without rings, the result is that of a plain outer join of the rows."""
    left, right = copies
    rings = lambda b: [[(b[1], b[2]), (b[3], b[2]), (b[3], b[4]), (b[1], b[4])]]
    schema = "{} long, rings array<array<struct<x: double, y: double>>>"
    a = spark.createDataFrame([(x[0], rings(x)) for x in left] + [(-1, None)], schema.format("a"))
    b = spark.createDataFrame([(x[0], rings(x)) for x in right] + [(-2, None)], schema.format("b"))
    pairs = Counter((x[0], y[0]) for x in left for y in right if met(x, y))
    alone = Counter((x[0], None) for x in [*left, (-1, 1e9, 1e9, 1e9, 1e9)] if not any(met(x, y) for y in right))
    assert Counter(map(tuple, vector.spatial_join(a, b, "a", "b", "left").collect())) == pairs + alone
    alone = Counter((None, y[0]) for y in [*right, (-2, 1e9, 1e9, 1e9, 1e9)] if not any(met(x, y) for x in left))
    assert Counter(map(tuple, vector.spatial_join(a, b, "a", "b", "right").collect())) == pairs + alone


def test_lists_of_copies_are_bounded(spark):
    rows = spark.range(5000).selectExpr("if(id % 100 = 0, null, id) as id", "if(id < 4000, 1.0D, id * 1.0D) as x")
    got = leaves.gathered(rows, "id", ["x"], held=16, most=100).collect()
    assert Counter((k, r.x) for r in got for k in r.id) == Counter(map(tuple, rows.collect()))
    assert max(len(r.id) for r in got) == 16
    # The 4,000 copies are dealt to 40 lists, about 100 keys each.
    whole = leaves.gathered(rows, "id", ["x"], most=100).filter("x = 1.0").select(F.size("id")).collect()
    assert len(whole) >= 35 and max(n for n, in whole) < 200


@pytest.mark.parametrize("many", [(10, 37), (37, 10), (2, 5)])
def test_files_of_pairs_of_copies_are_small(spark, tmp_path, many):
    """Rows come as runs of one side's keys beside a repeated sequence of the other's."""
    rng = random.Random(4)
    layers = [[(k, x, x, x + 0.33, x + 0.27) for i, k in enumerate(rng.sample(range(10_000_000), 60 * n)) for x in [1.0 + i % 60 / 1000]] for n in many]
    vector.boxes_that_meet(*(spark.createDataFrame(rows, BOXES) for rows in layers)).write.parquet(str(tmp_path / "pairs"))
    got = spark.read.parquet(str(tmp_path / "pairs"))
    pairs = len(layers[0]) * len(layers[1])
    assert got.count() == got.distinct().count() == pairs
    if max(many) >= 10:
        assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.3 * pairs


def test_more_rows_are_more_tasks(spark):
    layers = [spark.range(400).selectExpr("id", "id % 40 + 0.05D as west", "0.05D as south", "id % 40 + 0.35D as east", "0.35D as north") for _ in range(2)]
    got = vector.boxes_that_meet(*layers, 0.5, 20)
    assert got.rdd.getNumPartitions() == 40 and got.count() == 4000


@pytest.mark.parametrize("how", ["inner", "right"])
def test_files_of_pairs_of_polygons_are_small(spark, tmp_path, how):
    rng = random.Random(4)
    ring = lambda x: [[(x, x), (x + 0.33, x), (x + 0.33, x + 0.27), (x, x + 0.27)]]
    layers = [[(k, ring(1.0 + i % 60 / 1000)) for i, k in enumerate(rng.sample(range(10_000_000), 60 * n))] for n in (10, 37)]
    layers[1].append((-1, ring(9.0)))
    a, b = (spark.createDataFrame(rows, f"{n} long, rings array<array<struct<x: double, y: double>>>") for rows, n in zip(layers, "ab"))
    vector.spatial_join(a, b, "a", "b", how).write.parquet(str(tmp_path / "pairs"))
    got = spark.read.parquet(str(tmp_path / "pairs"))
    pairs = len(layers[0]) * (len(layers[1]) - 1)
    assert got.count() == got.distinct().count() == pairs + (how == "right")
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.3 * pairs
