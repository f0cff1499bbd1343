"""Grids, guards, outlines and decompositions against planted truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellscape.operators import change, grids, learning, ranks, regions, series, vector
from cellscape.operators.grids import Grid, Scene


def test_projections_go_back_and_forth():
    lon, lat = np.array([3.0, 5.9, 0.1, 4.2]), np.array([45.0, -33.0, 60.0, 0.0])
    for srid in (4326, 3857, 32631, 32731):
        x, y = grids.from_lonlat(lon, lat, srid, np)
        back = grids.to_lonlat(x, y, srid, np)
        assert np.allclose(back, (lon, lat), atol=1e-9)
    # The middle meridian's easting, and a known northing at 45 degrees.
    x, y = grids.from_lonlat(np.array([3.0]), np.array([45.0]), 32631, np)
    assert x[0] == pytest.approx(500000.0) and y[0] == pytest.approx(4982950.4, abs=0.1)
    with pytest.raises(ValueError):
        grids.from_lonlat(lon, lat, 2154, np)
    w, s, e, n = grids.envelope((2.0, 44.0, 4.0, 45.0), 4326, 3857)
    assert w == pytest.approx(math.radians(2) * 6378137) and s < n and e == pytest.approx(math.radians(4) * 6378137)


def test_alignment(spark):
    source = Grid(32631, 0.0, 40.0, 10.0, 10.0, 4, 4)
    cells = spark.createDataFrame([(r, c, float(r * 10 + c), None if (r, c) == (0, 0) else 1.0) for r in range(4) for c in range(4)], "r long, c long, a double, b double")
    same = grids.align_to(cells, source, source, ["a"]).collect()
    assert sorted((r.r, r.c, r.a) for r in same) == [(r, c, float(r * 10 + c)) for r in range(4) for c in range(4)]
    moved = Grid(32631, 10.0, 30.0, 10.0, 10.0, 3, 3)
    for method in ("nearest", "bilinear", "cubic", "average", "mode"):
        got = {(r.r, r.c): (r.a, r.b) for r in grids.align_to(cells, source, moved, ["a", "b"], method).collect()}
        assert got == {(r, c): (pytest.approx(float((r + 1) * 10 + c + 1)), 1.0) for r in range(3) for c in range(3)}, method
    half = Grid(32631, 0.0, 40.0, 20.0, 20.0, 2, 2)
    got = {(r.r, r.c): (r.a, r.b) for r in grids.align_to(cells, source, half, ["a", "b"], "average").collect()}
    assert got[0, 0] == (5.5, 1.0) and got[1, 1] == (27.5, 1.0)
    fine = Grid(32631, 0.0, 40.0, 5.0, 5.0, 8, 8)
    got = {(r.r, r.c): r.a for r in grids.align_to(cells, source, fine, ["a"], "average").collect()}
    assert got[3, 5] == 12.0 and len(got) == 64
    with pytest.raises(ValueError):
        grids.align_to(cells, source, half, ["a"], "lanczos")
    with pytest.raises(ValueError):
        grids.common_grid([source], resolution=-1.0)


def test_warp_covers_all_sources(spark):
    a, b = Grid(4326, 0.0, 1.0, 0.1, 0.1, 5, 5), Grid(4326, 0.4, 1.0, 0.1, 0.1, 5, 5)
    one = a.cells(spark).withColumn("v", F.lit(1.0))
    two = b.cells(spark).withColumn("v", F.when(F.col("r") > 0, 2.0))
    got, grid = grids.warp([(one, a), (two, b)], ["v"], method="nearest")
    assert (grid.width, grid.height) == (9, 5)
    v = {(r.r, r.c): r.v for r in got.collect()}
    assert v[0, 4] == 1.0 and v[1, 4] == 2.0 and v[1, 8] == 2.0 and v[0, 8] is None and len(v) == 45


def test_series_guard_and_crop(spark):
    g = Grid(32631, 0.0, 20.0, 10.0, 10.0, 2, 2)
    cells = g.cells(spark).withColumn("value", (F.col("r") * 2 + F.col("c")).cast("double"))
    old, new = Scene("a", "2020-01-01", g, cells), Scene("b", "2021-01-01", g, cells.withColumn("value", F.col("value") + 1))
    got = grids.load_series([new, old], reader=lambda x: x.withColumn("value", F.col("value") * 10)).collect()
    assert {(str(r.d), r.t) for r in got} == {("2020-01-01", 0), ("2021-01-01", 1)} and sum(r.value for r in got) == 160.0
    with pytest.raises(ValueError, match="date"):
        grids.load_series([Scene("x", None, g, cells)])
    grids.change_guard(old, new)
    far = Scene("c", "2022-01-01", Grid(32631, 5.0, 20.0, 10.0, 10.0, 2, 2), cells)
    for after in (old, Scene("z", "2020-01-01", g, cells), far):
        with pytest.raises(ValueError):
            grids.change_guard(old, after)
    d = change.difference(old.cells, new.cells)
    assert {r.diff for r in d.collect()} == {1.0}
    part, grid = grids.crop(cells, g, (10.0, 0.0, 20.0, 10.0), ["value"], srid=32631)
    assert [tuple(r) for r in part.collect()] == [(0, 0, 3.0)] and (grid.x0, grid.y0, grid.width) == (10.0, 10.0, 1)
    with pytest.raises(ValueError):
        grids.crop(cells, g, (100.0, 0.0, 110.0, 10.0), ["value"], srid=32631)


def test_polygons_meet(spark):
    ring = lambda *p: [[{"x": float(x), "y": float(y)} for x, y in p]]
    kind = "id long, rings array<array<struct<x:double,y:double>>>"
    big, inner, cross = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((1, 1), (2, 1), (1, 2)), ring((9, 9), (12, 9), (12, 12))
    touch, away, hollow = ring((10, 0), (12, 0), (12, 2)), ring((20, 20), (21, 20), (20, 21)), [*ring((0, 0), (5, 0), (5, 5), (0, 5)), *ring((0.5, 0.5), (4.5, 0.5), (4.5, 4.5), (0.5, 4.5))]
    left = spark.createDataFrame([(1, inner), (2, cross), (3, touch), (4, away)], kind).withColumnRenamed("id", "a")
    right = spark.createDataFrame([(10, big), (11, hollow)], kind).withColumnRenamed("id", "b")
    pairs = lambda **k: sorted(map(tuple, vector.spatial_join(left, right, "a", "b", cell=3.0, **k).collect()), key=str)
    assert pairs() == [(1, 10), (2, 10), (3, 10)]
    assert pairs(predicate="within") == [(1, 10)] and pairs(predicate="contains") == []
    assert pairs(how="left") == [(1, 10), (2, 10), (3, 10), (4, None)]
    assert pairs(how="right", predicate="within") == [(1, 10), (None, 11)]
    with pytest.raises(ValueError):
        pairs(predicate="overlaps")
    points = spark.createDataFrame([(1.5, 1.2), (30.0, 1.0), (2.0, 2.0)], "x double, y double")
    assert vector.clip_points(points, right, "b").count() == 2


def test_outlines_do_not_meet_themselves(spark):
    cells = [(1, 1), (0, 1), (0, 2), (0, 3), (1, 3), (2, 3), (2, 2)]
    labels = spark.createDataFrame([(r, c, 1) for r, c in cells], "r long, c long, label int")
    got = regions.polygonize(labels, 100.0).first()
    assert len(got.rings) == 2 and all(len({tuple(p) for p in ring}) == len(ring) for ring in got.rings)
    assert sorted(map(tuple, got.rings[1])) == [(2.0, 1.0), (2.0, 2.0), (3.0, 1.0), (3.0, 2.0)]


def test_floods_cross_many_tiles(spark):
    """A long valley with its outlet at one end, in tiles of two cells."""
    rows = [(r, c, 50.0 if r != 1 else (0.0 if c == 0 else 10.0 - 0.1 * c)) for r in range(3) for c in range(24)]
    df = spark.createDataFrame([(r, c, 60.0 if c == 23 else z) for r, c, z in rows], "r long, c long, z double")
    got = {(x.r, x.c): x.w for x in regions.fill_depressions(df, tile=8).collect()}
    assert got[1, 0] == 0.0 and all(got[1, c] == pytest.approx(9.9) for c in range(1, 23)) and len(got) == 72


def test_lower_envelope():
    rng = np.random.default_rng(2)
    x = np.sort(rng.uniform(0, 50, 60))
    g2 = np.where(rng.random(60) < 0.3, np.nan, rng.uniform(0, 30, 60))
    ok = np.isfinite(g2)
    assert np.allclose(regions._lowest(x, g2), ((x[:, None] - x[None, ok]) ** 2 + g2[None, ok]).min(axis=1))
    assert np.isnan(regions._lowest(x, np.full(60, np.nan))).all()


def test_decomposition_finds_planted_parts():
    t = np.arange(96)
    trend, seasonal = 0.02 * t, np.sin(2 * np.pi * t / 12)
    y = trend + seasonal + np.random.default_rng(0).normal(0, 0.05, 96)
    y[40] += 5
    a, b = series._decomposed(y, 12, 7, 15)
    keep = np.arange(96) != 40
    assert np.abs(a - trend).max() < 0.1 and np.abs(b - seasonal)[keep].max() < 0.15 and abs((y - a - b)[40]) > 4.5


def test_ranks_of_large_groups(spark):
    df = spark.createDataFrame([(k % 3, i) for k, i in enumerate(range(3000))], "g long, v long")
    got = ranks.shuffled(df, ["g"], ["v"], 1, "k").collect()
    for g in range(3):
        assert sorted(r.k for r in got if r.g == g) == list(range(1000))
    again = ranks.shuffled(df.repartition(7), ["g"], ["v"], 1, "k").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    split = learning.stratified(df, "g", ["v"]).groupBy("g", "held_out").count().collect()
    assert {(r.g, r.held_out): r["count"] for r in split} == {(g, h): 200 if h else 800 for g in range(3) for h in (True, False)}


def test_point_classes(spark, tmp_path):
    from cellscape.sources.points import read_points

    (tmp_path / "p.csv").write_text("x,y,z,c\n" + "\n".join(f"{i},{i},1.5,{i % 3}" for i in range(30)))
    got = read_points(spark, str(tmp_path / "p.csv"), classes=[2])
    assert got.count() == 10 and {r.cls for r in got.collect()} == {2} and read_points(spark, str(tmp_path / "p.csv")).count() == 30


def test_functions_for_sql(spark):
    from cellscape.functions import sql

    names = sql.register(spark)
    assert len(names) == len(set(names)) > 12
    assert spark.sql("SELECT ndvi(0.5D, 0.1D) AS v, ndvi(0D, 0D) AS gap, to_db(0.1D) AS db").first() == (pytest.approx(2 / 3), None, pytest.approx(-10.0))
    tiles = spark.sql("SELECT * FROM tile_boxes(0D, 0D, 6D, 4D, 2, 3)").collect()
    assert len(tiles) == 6 and {(r.tile, r.x0, r.y1) for r in tiles} >= {("T0_0", 0.0, 4.0), ("T1_2", 4.0, 2.0)}
    assert [str(r.d) for r in spark.sql("SELECT * FROM date_steps(DATE '2024-01-01', DATE '2024-01-20', 7)").collect()] == ["2024-01-01", "2024-01-08", "2024-01-15"]


def test_quantiles_in_two_passes(spark):
    from cellscape.operators.quantiles import quantiles

    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(0, 1, 500), np.full(300, 0.25), [1e6, -1e6]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "z double")
    shares = (0.0, 0.005, 0.25, 0.5, 0.77, 0.995, 1.0)
    assert np.allclose(quantiles(df, {"p": ("z", shares)}).first().p, np.quantile(v, shares))
    assert quantiles(spark.createDataFrame([(2.0,), (2.0,)], "z double"), {"p": ("z", (0.1, 0.9))}).first().p == [2.0, 2.0]
    assert quantiles(df.filter("z > 1e9"), {"p": ("z", (0.5,))}).first().p == [None]
    one, none = ((1, 5.0), (2, None))
    got = {r.k: (r.p, r.q) for r in quantiles(spark.createDataFrame([one, none], "k int, z double"), {"p": ("z", (0.3,)), "q": (F.col("z") * 2, (0.0, 1.0))}, ["k"]).collect()}
    assert got == {1: ([5.0], [10.0, 10.0]), 2: ([None], [None, None])}


def test_quantiles_are_bounded_and_equal_percentile(spark):
    """An outlier of 1e30, ties, and far more distinct values than the sketch holds: equal to the built-in, from few counted rows."""
    from cellscape.operators import quantiles as ops

    n = 200_000
    df = spark.range(0, n, 1, 8).selectExpr("id % 3 as k", "case when id = 7 then 1e30 when id % 5 = 0 then 0.5 else cast(xxhash64(id) as double) / 1e15 end as z", "cast(id % 10 as double) as few")
    shares = (0.01, 0.02, 0.5, 0.6, 0.98, 0.99)
    want = {r.k: (r.p, r.q) for r in df.groupBy("k").agg(F.percentile("z", F.array(*map(F.lit, shares))).alias("p"), F.percentile("few", F.array(F.lit(0.33))).alias("q")).collect()}
    found = ops.quantiles(df, {"p": ("z", shares), "q": ("few", (0.33,))}, ["k"])
    assert {r.k: (r.p, r.q) for r in found.collect()} == want
    # Rows that the second pass counts one by one: a few thousandths of all.
    ends = df.agg(F.percentile_approx("z", F.array(F.lit(0.5 - 2 / ops.ACCURACY), F.lit(0.5 + 2 / ops.ACCURACY)), F.lit(ops.ACCURACY)).alias("e"))
    assert df.crossJoin(ends).filter("z between e[0] and e[1]").select("z").distinct().count() < n / 500
