"""Reports, names and gates: planted cases."""

import json

import pytest
from pyspark.sql import functions as F

from cellscape.functions import indices, sql
from cellscape.operators import catalog, inspection


def test_dataset_report_captures_errors(spark, tmp_path):
    (tmp_path / "cloud.csv").write_text("1.0,2.0,3.5\n4,5,-6.25\n")
    (tmp_path / "broken.xyz").write_text("1 2 3\nnot a point\n7 8\n")
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [4, 1], [4, -2.5], [0, 1]]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [9, 9]}}]}
    (tmp_path / "zones.geojson").write_text(json.dumps(shape))
    (tmp_path / "bad.geojson").write_text('{"type": "FeatureColl')
    (tmp_path / "scene.tif").write_bytes(b"II*\0")
    (tmp_path / "empty.csv").write_text("\n")
    got = {r.name: r for r in inspection.dataset_report(spark, str(tmp_path)).collect()}
    assert len(got) == 6
    assert (got["cloud.csv"].n, got["cloud.csv"].west, got["cloud.csv"].north, got["cloud.csv"].detail, got["cloud.csv"].error) == (2, 1.0, 5.0, "z -6.25 to 3.50", None)
    assert got["broken.xyz"].n == 1 and got["broken.xyz"].error == "2 lines are not x, y, z"
    z = got["zones.geojson"]
    assert (z.n, z.west, z.south, z.east, z.north, z.detail, z.error) == (2, 0.0, -2.5, 9.0, 9.0, "Point,Polygon", None)
    assert got["bad.geojson"].error == "not a FeatureCollection" and got["scene.tif"].error == "files of type .tif are not read" and got["empty.csv"].error == "no points"
    kinds = {r.name: r.kind for r in inspection.file_kinds(spark, str(tmp_path)).collect()}
    assert kinds["scene.tif"] == "raster" and kinds["zones.geojson"] == "vector" and kinds["broken.xyz"] == "lidar"


def test_wavelengths_from_lists_tags_and_descriptions(spark):
    schema = "raster_id int, band int, description string, tags map<string,string>, band_tags map<string,string>"
    rows = [(1, k, None, {"wavelengths": "[0.45, 0.55]", "wavelength_unit": "um"}, {"wavelength": "999 nm"}) for k in (1, 2)]
    rows += [(2, k, "Band at 700 nm", {"WAVELENGTHS": "400 500 600"}, {"WAVELENGTH_UM": "0.9"} if k == 1 else {}) for k in (1, 2)]
    got = {(r.raster_id, r.band): (r.nm, r.source) for r in inspection.band_wavelengths(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 1): (450.0, "explicit_unit"), (1, 2): (550.0, "explicit_unit"), (2, 1): (900.0, "explicit_unit"), (2, 2): (700.0, "explicit_unit")}
    none = spark.createDataFrame([(3, 1, "no number", {}, {})], schema)
    with pytest.raises(Exception, match="no wavelength"):
        inspection.band_wavelengths(none).collect()
    assert inspection.band_wavelengths(none, allow_missing=True).first().nm is None
    mixed = spark.createDataFrame([(1, "assumed_nm"), (1, "assumed_um"), (2, "explicit_unit")], "raster_id int, source string")
    assert dict(map(tuple, inspection.wavelength_source(mixed).collect())) == {1: "assumed_um", 2: "explicit_unit"}


def test_class_labels_in_their_order(spark):
    df = spark.createDataFrame([({"class_3": "tall grass", "CLASSES": '{"3": "x", "4": "dry", "n": "no"}', "other_5": "z"}, "4: wet; 5 = salt pan, 6 - rock (7 ice")], "tags map<string,string>, text string")
    got = df.select(inspection.class_labels(F.col("tags"), F.col("text")).alias("m")).first().m
    assert got == {3: "Tall grass", 4: "Dry", 5: "Salt pan", 6: "Rock", 7: "Ice"}
    assert spark.range(1).select(inspection.class_labels(F.create_map().cast("map<string,string>"), F.lit(None).cast("string")).alias("m")).first().m == {}
    cells = spark.range(40).selectExpr("id as r", "cast(id as double) as v")
    with pytest.raises(Exception, match="not a classified band"):
        inspection.class_profile(cells, "v", F.create_map(F.lit(1), F.lit("a"))).collect()


def test_gates(spark):
    df = spark.range(100).selectExpr("id as r", "0 as c", "cast(null as double) as b1", *[f"case when id < {k} then cast(null as double) else 1.0D end as b{i}" for i, k in ((2, 80), (3, 70), (4, 40), (5, 10), (6, 10), (7, 10), (8, 99))], "0 as scl")
    # Bands 2, 4, 6 and 8 are probed: 80 % is missing in the second, 40 % in the fourth, where it ends.
    one = catalog.raster_quality(df, [f"b{i}" for i in range(1, 9)], "scl", geographic=True).first()
    assert (one.nodata, one.verdict, one.warnings) == (0.4, "ok", "no-data,geographic")
    assert catalog.raster_quality(df, "b1", "scl").first().verdict == "insufficient_data"
    reports = spark.createDataFrame([("ok",), ("ok",)], "verdict string")
    share = spark.createDataFrame([(0.1,)], "share double")
    verdict = lambda r, s=None: inspection.quality_gate(r, s).first().verdict
    assert [verdict(reports), verdict(reports, share), verdict(reports.limit(1), share), verdict(reports.limit(0))] == ["ok", "insufficient_data", "ok", "not_valid"]
    found = spark.createDataFrame([(1, 90.0, 1, "landsat-c2-l2"), (2, 40.0, 2, "landsat-c2-l2"), (3, 40.0, 3, "landsat-c2-l2"), (4, 30.0, 3, "landsat-c2-l2")], "item_id int, coverage double, dt int, collection string")
    ids = lambda box, df=found: {r.item_id for r in catalog.coverage_gate(df, box=box).filter("accepted").collect()}
    assert ids((0.0, 0.0, 1.0, 1.0)) == {1, 3, 4} and ids((0.0, 0.0, 1.0, 1.0), found.withColumn("collection", F.lit("sentinel-2-l2a"))) == set()


def test_reports_name_systems(spark):
    r = spark.createDataFrame([(1, 10, 20, 32631, 10.0, 10.0, 500000.0, 0.0), (2, 10, 20, 4326, 0.1, 0.1, 5.0, 50.0)], "raster_id int, width int, height int, srid int, dx double, dy double, x0 double, y0 double")
    b = {x.raster_id: x for x in inspection.raster_bounds(r).collect()}
    assert b[1].west == pytest.approx(3.0, abs=1e-6) and b[1].north == pytest.approx(0.0, abs=1e-9) and (b[2].west, b[2].east) == (5.0, 6.0)
    bands = spark.range(12).selectExpr("1 as raster_id", "cast(id + 1 as int) as band", "'B04' as label", "-1D as nodata", "id * 2D as max")
    got = {x.raster_id: x for x in inspection.raster_report(r.withColumn("tags", F.create_map(F.lit("s"), F.lit("Sentinel-2A"))), bands).collect()}
    assert (got[1].band_count, len(got[1].bands), got[1].bands_truncated, got[1].extent_km2) == (12, 10, True, 0.02) and got[1].bands[0].role == "red" and got[1].bands[9].max == 18.0
    assert (got[2].band_count, got[2].crs_is_projected, got[2].extent_km2, got[2].error) == (0, False, None, None)
    with pytest.raises(ValueError, match="zone_name"):
        inspection.filter_features(spark.createDataFrame([(1, "a")], "id int, zone_name string"), "other", [1])


def test_rasters_are_ranked_by_dates_and_changes(spark):
    names = ["aral_2020-06", "aral_2020-10", "aral_2026-06", "aral_2026-10"]
    r = spark.createDataFrame([(n,) for n in names], "raster string")
    best = lambda t, **k: catalog.match_rasters(spark.createDataFrame([(t,)], "target string"), r, **k).orderBy("place").first().raster
    assert best("water_frame_2026-10") == "aral_2026-10" and best("water_frame_2020-06") == "aral_2020-06"
    assert best("frame_oct2020") == "aral_2020-10"
    many = spark.createDataFrame([(f"diff{y}{w}-{i}",) for i in range(40) for y in (2020, 2021) for w in ("", "x")] + [("ndvi2020a",)], "raster string")
    t = spark.createDataFrame([("ndvi2020",), ("change2021",), ("flood2020_map",), ("diff2020-7",)], "target string")
    plain, grouped = (sorted(map(tuple, catalog.match_rasters(t, many, most=m).collect())) for m in (10_000, 5))
    assert plain == grouped and len(plain) == 12


def test_indices_and_aggregates_for_sql(spark):
    indices.register_index("twice_ndvi", ("nir", "red"), lambda b: 2 * (b["nir"] - b["red"]) / (b["nir"] + b["red"]))
    try:
        names = sql.register(spark)
        assert {"ibi", "lst", "twice_ndvi"} <= set(names) and len(names) == len(set(names))
        row = spark.sql("SELECT twice_ndvi(0.5D, 0.1D) AS t, ibi(0.3D, 0.4D, 0.1D, 0.2D) AS i, lst(21D) AS l").first()
        want = spark.createDataFrame([(0.3, 0.4, 0.1, 0.2)], "swir1 double, nir double, red double, green double").select(indices.index("ibi")).first()[0]
        assert row.t == pytest.approx(4 / 3) and row.i == pytest.approx(want) and row.l == 21.0
    finally:
        del indices.INDICES["twice_ndvi"]
    sql.register_aggregate(spark, "spread", lambda v: float(v.max() - v.min()))
    df = spark.createDataFrame([(1, 2.0), (1, 7.0), (2, 3.0)], "k int, v double")
    df.createOrReplaceTempView("values_of_k")
    assert dict(map(tuple, spark.sql("SELECT k, spread(v) FROM values_of_k GROUP BY k").collect())) == {1: 5.0, 2: 0.0}
