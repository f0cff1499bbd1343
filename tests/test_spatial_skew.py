"""Spatial joins where nearly all rows are in one place, and zonal work on row segments."""

import random

import pytest
from pyspark.sql import functions as F

from cellscape.operators import leaves, vector


@pytest.fixture(scope="module")
def city(spark):
    """900 of 1,000 points in one cell of 16, 150 of them at one place; small squares in the city and wide ones around."""
    rng = random.Random(9)
    points = [(i, 5.0, 5.0) if i < 150 else (i, rng.uniform(0, 16), rng.uniform(0, 16)) if i < 900 else (i, rng.uniform(-200, 200), rng.uniform(-200, 200)) for i in range(1000)]
    squares = [(k, x, y, x + w, y + w) for k in range(120) for x, y, w in [(rng.uniform(0, 15), rng.uniform(0, 15), 1.0) if k < 100 else (rng.uniform(-200, 150), rng.uniform(-200, 150), 40.0)]]
    return points, squares


def rings(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]


def test_points_in_polygons_under_skew(spark, city):
    points, squares = city
    p = spark.createDataFrame([*points, (-1, None, 2.0)], "id long, x double, y double")
    z = spark.createDataFrame([(k, rings(*box)) for k, *box in squares], "k long, rings array<array<struct<x: double, y: double>>>")
    want = sorted((i, k) for i, x, y in points for k, x0, y0, x1, y1 in squares if x0 <= x < x1 and y0 <= y < y1)
    for most in (100_000, 50):
        got = vector.points_in_polygons(p, z, "k", most=most)
        assert sorted((r.id, r.k) for r in got.collect()) == want


def test_hot_cells_are_cut_and_dealt(spark, city):
    points, squares = city
    a = leaves.boxed(spark.createDataFrame(points, "id long, x double, y double"), *map(F.col, ("x", "y", "x", "y"))).drop("x", "y")
    b = leaves.boxed(spark.createDataFrame(squares, "k long, a double, b double, c double, d double"), *map(F.col, ("a", "b", "c", "d"))).drop("a", "b", "c", "d")
    met = leaves.joined(a, b, 16.0, most=50)
    of = met.select(*leaves.KEYS, "id").distinct().groupBy(*leaves.KEYS).count().agg(F.max("count")).first()[0]
    assert of <= 70  # 900 rows of one cell; parts of the 150 at one place are dealt by hash
    assert met.select("__level").distinct().count() > 1
    one = leaves.joined(a, b, 16.0).filter(leaves.at_corner(16.0)).select("id", "k")
    assert sorted(map(tuple, met.filter(leaves.at_corner(16.0)).select("id", "k").collect())) == sorted(map(tuple, one.collect()))


def test_boxes_and_distances_under_skew(spark, city):
    points, squares = city
    boxes = spark.createDataFrame(squares, "id long, west double, south double, east double, north double")
    want = sorted((a[0], b[0]) for a in squares for b in squares if max(a[1], b[1]) <= min(a[3], b[3]) and max(a[2], b[2]) <= min(a[4], b[4]))
    for most in (100_000, 10):
        assert sorted(map(tuple, vector.boxes_that_meet(boxes, boxes, 2.0, most).collect())) == want
    few = points[:300]
    df = spark.createDataFrame(few, "id long, x double, y double")
    near = sorted((a[0], b[0]) for a in few for b in few if ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= 1.5)
    for most in (100_000, 20):
        assert sorted((r.left_id, r.right_id) for r in vector.within_distance(df, df, 1.5, most).collect()) == near


def test_zonal_stats_on_wide_rows_with_holes(spark):
    rng = random.Random(4)
    cells = {(r, c): (None if rng.random() < 0.1 else rng.uniform(-5, 5)) for r in range(4) for c in range(-300, 900) if rng.random() < 0.9}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "r long, c long, z double")
    shapes = {1: [[(-300.0, 0.0), (900.0, 0.0), (900.0, 4.0), (-300.0, 4.0)], [(100.0, 1.0), (700.0, 1.0), (700.0, 3.0), (100.0, 3.0)]], 2: [[(10.2, 0.0), (12.7, 0.0), (12.7, 1.0), (10.2, 1.0)]], 3: [[(5000.0, 0.0), (5001.0, 0.0), (5001.0, 1.0)]]}
    zones = spark.createDataFrame(list(shapes.items()), "k long, rings array<array<struct<x: double, y: double>>>")
    got = {r.k: r for r in vector.zonal_stats(zones, df, "k", "z").collect()}
    held = {1: [v for (r, c), v in cells.items() if v is not None and not (100 <= c < 700 and 1 <= r < 3)], 2: [v for (r, c), v in cells.items() if v is not None and r == 0 and c in (10, 11, 12)]}
    for k, vs in held.items():
        assert (got[k].n, got[k].min, got[k].max) == (len(vs), min(vs), max(vs)) and got[k].mean == pytest.approx(sum(vs) / len(vs), abs=1e-5)
    assert got[3].n == 0 and got[3].mean is None
    assert vector.cells_in(zones, "k", df, ["z"]).filter("k = 1").count() == sum(not (100 <= c < 700 and 1 <= r < 3) for r, c in cells)
    plan = vector.zonal_stats(zones, df, "k", "z")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") == 5  # rings, edges, rows, spans and segments: no cells


def test_boxes_are_compared_by_their_ends(spark):
    """Boxes, closed rings and triangles against the exact test of each pair; a plan whose test of sides boxes skip."""
    rng = random.Random(3)
    shapes = {}
    for k in range(90):
        x, y, w, h = rng.randint(0, 12) / 2, rng.randint(0, 12) / 2, rng.randint(1, 6) / 2, rng.randint(1, 6) / 2
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        shapes[k] = [[ring, ring[::-1], ring + ring[:1], ring[:3], [ring[0], ring[1], ring[0], ring[3]], [ring[0], ring[2], ring[1], ring[3]]][k % 6]]
    df = spark.createDataFrame(list(shapes.items()), "k long, rings array<array<struct<x: double, y: double>>>")
    boxes = {r.k for r in df.filter(vector.is_box(F.col("rings"))).select("k").collect()}
    assert boxes == {k for k in shapes if k % 6 < 3}
    a, b = df.withColumnsRenamed({"k": "a"}), df.withColumnsRenamed({"k": "b"})
    pairs = a.crossJoin(b.withColumnRenamed("rings", "other"))
    for how in ("intersects", "within", "contains"):
        want = pairs.filter(vector.polygons_meet(F.col("rings"), F.col("other"), how)).select("a", "b")
        assert sorted(map(tuple, vector.spatial_join(a, b, "a", "b", "inner", how).collect())) == sorted(map(tuple, want.collect())), how
