"""Small inputs with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellscape.functions import catalog as fn
from cellscape.functions.indices import index, register_index
from cellscape.functions.special import t_tail
from cellscape.operators import catalog, cells, focal, graph, grids, learning, regions, series, spectral, summaries, vector


def grid(spark, values):
    """Cells (r, c, z) of a list of rows."""
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r, row in enumerate(values) for c, v in enumerate(row)], "r long, c long, z double")


def as_array(df, value="value"):
    rows = df.select("r", "c", value).collect()
    out = np.full((1 + max(x.r for x in rows), 1 + max(x.c for x in rows)), np.nan)
    for r, c, v in rows:
        out[r, c] = np.nan if v is None else v
    return out


def test_ndvi_with_no_data(spark):
    df = spark.createDataFrame([(100.0, 300.0), (200.0, 200.0), (300.0, 100.0), (None, None), (0.0, 0.0)], "red double, nir double")
    assert [x[0] for x in df.select(index("ndvi")).collect()] == [0.5, 0.0, -0.5, None, None]
    with pytest.raises(ValueError):
        index("nothing")
    register_index("plain", ("red",), lambda b: b["red"] * 2)
    assert df.select(index("plain")).first()[0] == 200.0


def test_calibration(spark):
    dn = spark.createDataFrame([(0, 0, 9091.0), (0, 1, 20000.0)], "r long, c long, red double")
    got = [x.red for x in cells.surface_reflectance(dn, ["red"], sensor="landsat").orderBy("c").collect()]
    assert got == pytest.approx([0.05, 0.35], abs=1e-4)
    hot = spark.createDataFrame([(0, 0, 44177.6)], "r long, c long, thermal double")
    assert cells.celsius(hot).first().thermal == pytest.approx(26.85, abs=0.01)
    before = spark.createDataFrame([(0, 0, 1000.0), (0, 1, 4000.0)], "r long, c long, red double")
    after = spark.createDataFrame([(0, 0, 2000.0), (0, 1, 5000.0)], "r long, c long, red double")
    a = [x.red for x in cells.surface_reflectance(before, ["red"], date="2021-06-01").orderBy("c").collect()]
    b = [x.red for x in cells.surface_reflectance(after, ["red"], date="2023-06-01").orderBy("c").collect()]
    assert a == pytest.approx(b)


def test_roles_are_never_guessed(spark):
    labels = spark.createDataFrame([(1, "B4", "red"), (2, "B04", "red"), (3, "B8", "nir")], "band int, label string, role string")
    assert cells.resolve_role(labels, "nir") == "B8"
    for role, explicit in (("red", None), ("blue", None), ("nir", 1)):
        with pytest.raises(cells.BandError):
            cells.resolve_role(labels, role, explicit)


def test_dates_and_labels(spark):
    texts = ["2021-3-05", "05/03/2021", "02/14/2020", "2020-13-40", "nothing"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(x[0]) for x in df.select(fn.normalized_date(F.col("t"), F.lit("2000-01-01").cast("date"))).collect()]
    assert got == ["2021-03-05", "2021-03-05", "2020-02-14", "2000-01-01", "2000-01-01"]


def test_masks_and_quality(spark):
    m = grid(spark, [[0, 1], [1, 1]])
    some, all_ = m.filter("z > 0"), m
    assert cells.combine_masks([all_, some], "and").count() == 3
    assert cells.combine_masks([all_, some], "and_not").count() == 1
    with pytest.raises(ValueError):
        cells.combine_masks([some, some], "xor")
    with pytest.raises(ValueError):
        cells.aoi_window(m, 0, 10000, 0, 10000, most=36_000_000)
    mostly_empty = spark.createDataFrame([(r, c, 1.0 if r < 5 and c < 5 else None, 4) for r in range(20) for c in range(20)], "r long, c long, z double, scl int")
    assert catalog.raster_quality(mostly_empty, "z", "scl").first().verdict == "insufficient_data"


def test_coverage_gate(spark):
    items = spark.createDataFrame([(1, "2023-01-01", 32.5), (2, "2023-01-02", 32.5), (3, "2023-01-02", 60.0)], "item_id long, dt string, coverage double")
    assert {x.item_id: x.accepted for x in catalog.coverage_gate(items).collect()} == {1: False, 2: True, 3: True}


def test_linear_series(spark):
    rows = [(k, f"{2020 + t}-05-01", 0.2 + 0.05 * t) for k in range(3) for t in range(6)]
    s = spark.createDataFrame(rows, "cell long, d string, y double").withColumn("d", F.col("d").cast("date"))
    t = series.ols_trend(s).first()
    assert t.slope == pytest.approx(0.05, abs=1e-4) and t.p < 0.01
    assert series.mann_kendall(s).first().significant
    assert series.sens_slope(s).first().slope == pytest.approx(0.05, abs=1e-3)
    assert t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)


def test_change_points(spark):
    rng = random.Random(3)
    rows = [(1, t, (0.0 if t < 20 else 5.0) + rng.gauss(0, 0.2)) for t in range(40)] + [(2, t, 1.0) for t in range(40)]
    s = spark.createDataFrame(rows, "cell long, t int, y double").selectExpr("cell", "date_add(date'2020-01-01', t) as d", "y")
    seg = {x.cell: (x.changes, x.first) for x in series.segments(s).collect()}
    assert seg == {1: (1, 20), 2: (0, -1)}
    assert {x.cell: x.changes > 0 for x in series.cusum(s).collect()} == {1: True, 2: False}


def test_decomposition_and_clusters(spark):
    rows = [(k, t, (0.1 * t if k < 5 else 10 - 0.1 * t) + math.sin(2 * math.pi * t / 6)) for k in range(10) for t in range(36)]
    s = spark.createDataFrame(rows, "cell long, t int, y double").selectExpr("cell", "date_add(date'2020-01-01', t) as d", "y")
    out = series.stl(s, period=6).filter("cell = 0").orderBy("d").toPandas()
    assert np.allclose(out["observed"], out["trend"] + out["seasonal"] + out["resid"])
    assert np.corrcoef(out["seasonal"], np.sin(2 * np.pi * np.arange(36) / 6))[0, 1] > 0.95
    got = {x.cell: x.cluster for x in series.cluster_series(s, k=2).collect()}
    assert len({got[k] for k in range(5)}) == 1 and len({got[k] for k in range(5, 10)}) == 1 and got[0] != got[9]


def test_focal_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50, (9, 11)).astype(float)
    g = grid(spark, a.tolist())
    pad = np.pad(a, 2, mode="symmetric")
    mean = np.array([[pad[r : r + 5, c : c + 5].mean() for c in range(11)] for r in range(9)])
    assert np.allclose(as_array(focal.speckle_filter(g, "z")), mean)
    edge = np.pad(a, 1, mode="edge")
    med = np.array([[np.median(edge[r : r + 3, c : c + 3]) for c in range(11)] for r in range(9)])
    assert np.allclose(as_array(focal.median3(g, "z")), med)
    gx = sum(w * (edge[1 + k : 10 + k, 2:] - edge[1 + k : 10 + k, :-2]) for k, w in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(w * (edge[2:, 1 + k : 12 + k] - edge[:-2, 1 + k : 12 + k]) for k, w in ((-1, 1), (0, 2), (1, 1)))
    assert np.allclose(as_array(focal.slope(g, "z", 10.0, 10.0)), np.degrees(np.arctan(np.hypot(gx, gy) / 80)))


def test_bimodality(spark):
    rng = np.random.default_rng(2)
    make = lambda x: spark.createDataFrame([(float(v),) for v in x], "z double")
    assert not summaries.bimodality(make(rng.normal(10, 2, 4000)), "z").first().bimodal
    assert not summaries.bimodality(make(rng.uniform(0, 10, 4000)), "z").first().bimodal
    two = np.concatenate([rng.normal(-15, 1, 2000), rng.normal(5, 1, 2000)])
    assert summaries.bimodality(make(two), "z").first().bimodal


def test_regions(spark):
    text = ["110011", "100001", "101101", "000100"]
    mask = grid(spark, [[int(x) for x in row] for row in text]).filter("z > 0")
    labels = regions.label_regions(mask)
    got = {(x.r, x.c): x.label for x in labels.collect()}
    assert got[0, 0] == 1 and got[2, 0] == 1 and got[0, 4] == 2 and got[2, 5] == 2 and got[2, 2] == 3 and got[3, 3] == 3
    assert regions.region_summary(labels).first().asDict() == {"regions": 3, "largest": 4, "sizes": [4, 4, 3]}
    assert regions.filter_small(labels, 4).select("label").distinct().count() == 2
    polygons = regions.polygonize(labels, 100.0)
    assert polygons.agg(F.bround(F.sum("area_ha"), 3)).first()[0] == pytest.approx(0.11)


def test_valley(spark):
    """A V-shaped valley with a pit: filled to its spill level, water gathers along the axis."""
    z = [[5 * abs(c - 10) + (20 - r) for c in range(21)] for r in range(21)]
    z[10][10] = -50
    dem = grid(spark, z)
    for tile in (256, 8):
        filled = {(x.r, x.c): x.w for x in regions.fill_depressions(dem, tile=tile).collect()}
        assert filled[10, 10] == 9.0 and all(filled[r, c] >= z[r][c] for r in range(21) for c in range(21))
    flow = regions.flow_direction(regions.fill_depressions(dem, tile=8), 10.0, 10.0)
    acc = {(x.r, x.c): x.acc for x in regions.flow_accumulation(flow).collect()}
    ends = {(x.r, x.c) for x in flow.filter("to_r is null").collect()}
    assert sum(acc[k] for k in ends) == 21 * 21
    assert acc[20, 10] > 200
    wet = as_array(regions.wetness_index(dem, 10.0, 10.0))
    assert wet[18, 10] > wet[18, 2]


def test_distance(spark):
    g = grid(spark, [[0] * 6 for _ in range(5)])
    d = as_array(regions.distance_to_mask(g, spark.createDataFrame([(2, 3)], "r long, c long"), 2.0, 1.0))
    assert d[2, 3] == 0 and d[0, 3] == 2 and d[2, 0] == 6 and d[0, 0] == pytest.approx(math.hypot(2, 6))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (20, 1)], "a long, b long")
    assert {x.node: x.comp for x in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 20: 1, 9: 7, 8: 7, 7: 7}
    assert graph.components(links.limit(0)).count() == 0


def test_polygons(spark):
    hole = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]]
    p = spark.createDataFrame([(1, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in hole])], "k long, rings array<array<struct<x:double,y:double>>>")
    assert vector.rasterize(p, "k").count() == 96
    assert p.select(vector.ring_area("rings")).first()[0] == 96.0
    pts = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (11.0, 1.0)], "x double, y double")
    assert [(r.x, r.y) for r in vector.points_in_polygons(pts, p, "k").collect()] == [(1.0, 1.0)]
    e, n = spark.range(1).select(*grids.from_lonlat(F.lit(3.0) + F.col("id"), F.lit(45.0), 32631)).first()
    assert e == pytest.approx(500000.0, abs=1e-3) and n == pytest.approx(4982950.4, abs=0.1)


def test_spectra(spark):
    rng = np.random.default_rng(0)
    members = rng.uniform(0.1, 0.9, (40, 3))
    mix = members @ np.array([0.5, 0.3, 0.2])
    s = spark.createDataFrame([(1, 0, mix.tolist()), (2, 0, members[:, 1].tolist())], "vec_id long, label int, spectrum array<double>")
    got = {x.vec_id: x for x in spectral.unmix_fcls(s, members).collect()}
    assert got[1].abundance == pytest.approx([0.5, 0.3, 0.2], abs=1e-3) and got[1].rmse < 1e-3
    assert {x.vec_id: x.angle for x in spectral.spectral_angle(s, members[:, 1].tolist()).collect()}[2] == pytest.approx(0.0, abs=1e-6)
    wl = np.linspace(2050, 2350, 31)
    y = 0.8 - 0.3 * np.exp(-(((wl - 2200) / 30) ** 2))
    r = spectral.hull_removed(wl, y)
    assert r[0] == r[-1] == 1.0 and np.nanmax(r) <= 1 + 1e-12 and 0.25 < 1 - r[15] < 0.45


def test_models_recover_planted_classes(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), *map(float, rng.normal(3 * k, 0.5, 3))) for k in rng.integers(0, 3, 300)]
    df = spark.createDataFrame(rows, "label long, f1 double, f2 double, f3 double").withColumn("label", F.col("label").cast("double"))
    for kind in ("random_forest", "logistic_regression"):
        out = learning.fit(df, ["f1", "f2", "f3"], kind).transform(df)
        assert out.filter("label = prediction").count() > 290
    cells_ = df.withColumns({"r": F.monotonically_increasing_id(), "c": F.lit(0)}).withColumn("f1", F.when(F.col("r") % 2 == 0, F.col("f1")))
    assert learning.predict_cells(learning.fit(df, ["f1", "f2", "f3"], "logistic_regression"), cells_, ["f1", "f2", "f3"]).filter("prediction = -9999").count() == cells_.filter("f1 is null").count()


def test_rgb_features_against_numpy(spark):
    rng = np.random.default_rng(9)
    img = rng.uniform(0.05, 0.6, (34, 33, 3))
    df = spark.createDataFrame([(r, c, *map(float, img[r, c])) for r in range(34) for c in range(33)], "r long, c long, red double, green double, blue double")
    got = learning.rgb_features_33(df).toPandas().sort_values(["r", "c"])
    assert len(got.columns) == 35 and len(got) == 34 * 33

    def box(a, k):
        p = np.pad(a, k // 2, mode="symmetric")
        return np.array([[p[r : r + k, c : c + k].mean() for c in range(a.shape[1])] for r in range(a.shape[0])])

    br = img.mean(axis=2)
    at = lambda n: got[n].to_numpy().reshape(34, 33)
    assert np.allclose(at("ms_coarse"), box(br, 31)) and np.allclose(at("ms_fine"), box(br, 3))
    lbp = sum((br >= np.roll(np.roll(br, a, 0), b, 1)).astype(float) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)
    assert np.allclose(at("lbp_mean"), box(lbp, 15)) and np.allclose(at("lbp_mixed"), box((lbp == 4).astype(float), 15))
    assert np.allclose(at("contrast"), box(np.abs(br - box(br, 7)), 7) * 2)
    assert np.allclose(at("b_iqr"), np.sqrt(np.maximum(box(img[:, :, 2] ** 2, 5) - box(img[:, :, 2], 5) ** 2, 0)) * 1.35)


def test_points_and_geojson_round_trip(spark, tmp_path):
    from cellscape.sources.geojson import parse_features, write_geojson
    from cellscape.sources.points import read_points

    (tmp_path / "p.xyz").write_text("\n".join(f"{i} {i + 100} {i + 10}" for i in range(100)))
    assert read_points(spark, str(tmp_path / "p.xyz"), bbox=(40, 0, 59, 1000)).count() == 20
    assert read_points(spark, str(tmp_path / "p.xyz"), most=20).count() == 20
    ring = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]]
    df = spark.createDataFrame([(7, "a", ring)], "k long, name string, rings array<array<struct<x:double,y:double>>>")
    write_geojson(df, str(tmp_path / "g"))
    back = parse_features(spark.read.text(str(tmp_path / "g")), "value", "k long, name string").first()
    assert (back.k, back.name, [(p.x, p.y) for p in back.rings[0]]) == (7, "a", [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])


def test_tiles_round_trip(spark, tmp_path):
    g = grid(spark, [[r * 10 + c for c in range(10)] for r in range(10)])
    cells.write_tiles(g, str(tmp_path / "t"), size=4)
    got = cells.window_of_tiles(spark.read.parquet(str(tmp_path / "t")), 2, 5, 3, 9, size=4)
    assert sorted(x.z for x in got.collect()) == sorted(float(r * 10 + c) for r in range(2, 5) for c in range(3, 9))
    with pytest.raises(ValueError):
        cells.write_band(g.withColumnRenamed("z", "value"), str(tmp_path / "b"), nodata=5.0)
    cells.write_band(g.select("r", "c", F.when(F.col("z") > 5, F.col("z")).alias("value")), str(tmp_path / "b"), nodata=-1.0)
    assert spark.read.parquet(str(tmp_path / "b")).filter("value = -1").count() == 6


def test_streams_equal_their_batch_twins(spark):
    from cellscape.plans import registry

    got = registry.QUERIES["stream_cusum"](spark, "/root/testdata/sf0.001")
    assert got.count() == 1000 and got.filter("hit").count() < 1000
