"""Queries on polygons, points and grids that meet (section D, E3, E4, E9, A8, A9, A13-A15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscape.operators import cells as cell_ops
from cellscape.operators import inspection
from cellscape.operators import grids
from cellscape.operators import vector as ops
from cellscape.plans.fixtures import table, view
from cellscape.plans.registry import query
from cellscape.sources import geojson
from cellscape.sources.scratch import new_folder

_scene = lambda s, d: view(s, d, "scene_cells")


def zones(spark, sf_dir):
    return view(spark, sf_dir, "zones").select("zone_id", "zone_name", ops.triangle(*[F.col(k) for k in ("x0", "y0", "x1", "y1", "x2", "y2")]).alias("rings"))


def _side(xa, ya, xb, yb):
    return f"CASE WHEN (({ya} > y) <> ({yb} > y)) AND x < ({xb} - {xa}) * (y - {ya}) / nullif({yb} - {ya}, 0) + {xa} THEN 1 ELSE 0 END"


_IN = f"({_side('x0', 'y0', 'x1', 'y1')} + {_side('x1', 'y1', 'x2', 'y2')} + {_side('x2', 'y2', 'x0', 'y0')}) % 2 = 1"
_CELLS_IN = f"__z AS (SELECT zone_id, s.* FROM (SELECT *, c + 0.5 AS x, r + 0.5 AS y FROM scene_cells) s, zones WHERE {_IN})"


@query("zonal_ndvi", f"__q AS (SELECT quantile_cont(red, 0.99) AS r99, quantile_cont(red, 0.01) AS r1, quantile_cont(nir, 0.99) AS n99, quantile_cont(nir, 0.01) AS n1 FROM scene_cells), {_CELLS_IN}, __v AS (SELECT zone_id, greatest(0.0001, least(1.5, (red + CASE WHEN r1 > 700 THEN -1000.0 ELSE 0.0 END) / 10000.0)) AS red, greatest(0.0001, least(1.5, (nir + CASE WHEN n1 > 700 THEN -1000.0 ELSE 0.0 END) / 10000.0)) AS nir FROM __z, __q WHERE red IS NOT NULL), __n AS (SELECT zone_id, (nir - red) / nullif(nir + red, 0) AS v FROM __v) SELECT z.zone_id, count(v) AS n, round_even(avg(v), 6) AS mean_ndvi, count(*) FILTER (v > 0.4) AS green, round_even(count(*) FILTER (v > 0.4) * 100 / 10000.0, 3) AS green_ha FROM zones z LEFT JOIN __n ON z.zone_id = __n.zone_id GROUP BY z.zone_id", ("scene_cells", "zones"))
def zonal_ndvi(spark, sf_dir):
    """Flagship: roles, calibration, NDVI, polygons, zone means and the area above 0.4."""
    ndvi = cell_ops.compute_index(_scene(spark, sf_dir), "ndvi", date="2023-05-01")
    z = zones(spark, sf_dir)
    got = ops.cells_in(z, "zone_id", ndvi, ["value"]).groupBy("zone_id").agg(F.count("value").alias("n"), F.bround(F.avg("value"), 6).alias("mean_ndvi"), F.count_if(F.col("value") > 0.4).alias("green"))
    return z.select("zone_id").join(got, "zone_id", "left").na.fill(0, ["n", "green"]).withColumn("green_ha", F.bround(F.col("green") * 100 / 10000.0, 3))


query("rasterize", f"{_CELLS_IN} SELECT zone_id, r, c FROM __z", ("scene_cells", "zones"))(lambda s, d: ops.cells_in(zones(s, d), "zone_id", _scene(s, d), []).select("zone_id", "r", "c"))
query("zonal_stats", f"{_CELLS_IN} SELECT z.zone_id, count(nir) AS n, round_even(avg(nir), 6) AS mean, min(nir) AS min, max(nir) AS max FROM zones z LEFT JOIN __z ON z.zone_id = __z.zone_id GROUP BY z.zone_id", ("scene_cells", "zones"))(lambda s, d: ops.zonal_stats(zones(s, d), _scene(s, d), "zone_id", "nir"))
query("zonal_series", f"{_CELLS_IN}, __t AS (SELECT zone_id, 0 AS t, red AS v FROM __z UNION ALL SELECT zone_id, 1, nir FROM __z) SELECT t, zone_id, round_even(avg(v), 6) AS mean, median(v) AS median, sum(v) AS sum, round_even(stddev_pop(v), 6) AS std FROM __t GROUP BY ALL", ("scene_cells", "zones"))(
    lambda s, d: ops.zonal_series(zones(s, d), _scene(s, d).select("r", "c", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(b).alias("value")) for t, b in enumerate(("red", "nir"))])).alias("x")).select("r", "c", "x.t", "x.value"), "zone_id")
)
query("sample_polygons", f"{_CELLS_IN} SELECT zone_id, r, c, red, nir FROM __z WHERE red IS NOT NULL AND nir IS NOT NULL", ("scene_cells", "zones"))(lambda s, d: ops.sample_at_polygons(zones(s, d), _scene(s, d), "zone_id", ["red", "nir"]))
query("polygon_area", "SELECT round_even(sum(abs(x0 * (y1 - y2) + x1 * (y2 - y0) + x2 * (y0 - y1)) / 2 * 100) / 10000, 6) AS hectares FROM zones", "zones")(lambda s, d: zones(s, d).agg(F.bround(F.sum(ops.ring_area("rings") * 100) / 10000, 6).alias("hectares")))
query("sjoin_point_polygon", f"SELECT zone_id, count(*) AS n, round_even(sum(z), 4) AS total FROM (SELECT p.x, p.y, p.z, zones.* FROM points p, zones) WHERE {_IN} GROUP BY zone_id", ("points", "zones"))(
    lambda s, d: ops.points_in_polygons(view(s, d, "points"), zones(s, d), "zone_id").groupBy("zone_id").agg(F.count("*").alias("n"), F.bround(F.sum("z"), 4).alias("total"))
)
query("sjoin_bbox", "SELECT a.id AS left_id, b.id AS right_id FROM footprints a JOIN service_areas b ON a.west <= b.east AND b.west <= a.east AND a.south <= b.north AND b.south <= a.north", ("footprints", "service_areas"))(
    lambda s, d: ops.boxes_that_meet(view(s, d, "footprints"), view(s, d, "service_areas"))
)
_pts = lambda s, d: table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37 % 1000 / 10.0).alias("x"), (F.col("s_suppkey") * 91 % 1000 / 10.0).alias("y"))
_PTS = "(SELECT s_suppkey AS id, s_suppkey * 37 % 1000 / 10.0 AS x, s_suppkey * 91 % 1000 / 10.0 AS y FROM supplier)"
query("within_distance", f"SELECT a.id AS left_id, b.id AS right_id, round_even(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM {_PTS} a, {_PTS} b WHERE a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 7.5")(
    lambda s, d: ops.within_distance(_pts(s, d), _pts(s, d), 7.5).filter("left_id < right_id").withColumn("distance", F.bround("distance", 6))
)
# Layers of polygons on cells: zones, and the same shifted four cells to the right.
_Z2 = "__y AS (SELECT zone_id, s.* FROM (SELECT *, c + 0.5 - 4 AS x, r + 0.5 AS y FROM scene_cells) s, zones WHERE " + _IN + ")"


def _shifted(spark, sf_dir):
    return view(spark, sf_dir, "zones").select("zone_id", ops.triangle(*[F.col(k) + (4 if k[0] == "x" else 0) for k in ("x0", "y0", "x1", "y1", "x2", "y2")]).alias("rings"))


def _overlay(how):
    return lambda s, d: ops.overlay(zones(s, d).withColumnRenamed("zone_id", "a"), _shifted(s, d).withColumnRenamed("zone_id", "b"), "a", "b", how, _scene(s, d))


query("overlay_intersection", f"{_CELLS_IN}, {_Z2} SELECT p.zone_id AS a, q.zone_id AS b, count(*) AS cells, count(*) * 100.0 AS area_m2 FROM __z p JOIN __y q ON p.r = q.r AND p.c = q.c GROUP BY ALL", ("scene_cells", "zones"))(lambda s, d: _overlay("intersection")(s, d).groupBy("a", "b").agg(F.count("*").alias("cells"), (F.count("*") * 100.0).alias("area_m2")))
query("overlay_union", f"{_CELLS_IN}, {_Z2} SELECT p.zone_id AS a, q.zone_id AS b, count(*) AS cells FROM __z p FULL JOIN __y q ON p.r = q.r AND p.c = q.c GROUP BY ALL", ("scene_cells", "zones"))(lambda s, d: _overlay("union")(s, d).groupBy("a", "b").agg(F.count("*").alias("cells")))
query("clip", f"{_CELLS_IN}, {_Z2} SELECT p.zone_id, p.r, p.c FROM __z p WHERE EXISTS (SELECT 1 FROM __y q WHERE p.r = q.r AND p.c = q.c)", ("scene_cells", "zones"))(lambda s, d: _overlay("clip")(s, d).select(F.col("a").alias("zone_id"), "r", "c"))
query("filter_features", "SELECT zone_id, zone_name FROM zones WHERE zone_name IN ('ASIA', 'EUROPE')", "zones")(lambda s, d: inspection.filter_features(zones(s, d), "zone_name", ["ASIA", "EUROPE"]).select("zone_id", "zone_name"))
query("sample_points", "SELECT p.id, s.red, s.nir FROM (SELECT id, CAST(floor(x / 2.5) AS BIGINT) AS c, CAST(floor(y / 25.0) AS BIGINT) AS r FROM " + _PTS + ") p LEFT JOIN scene_cells s ON p.r = s.r AND p.c = s.c", "scene_cells")(
    lambda s, d: ops.sample_at_points(_pts(s, d).withColumns({"x": F.col("x") / 2.5, "y": F.col("y") / 25.0}), _scene(s, d), ["red", "nir"]).select("id", "red", "nir")
)
query("points_bbox", "SELECT x, y, z FROM points WHERE x BETWEEN 20 AND 40 AND y BETWEEN 10 AND 30", "points")(lambda s, d: view(s, d, "points").filter(F.col("x").between(20, 40) & F.col("y").between(10, 30)).select("x", "y", "z"))
# The scene's grid in degrees, and the same cells on whole metres.
_H = "(SELECT max(r) + 1 AS h FROM scene_cells)"


def _grid(spark, sf_dir, srid=4326):
    rows = _scene(spark, sf_dir).agg(F.max("r")).first()[0] + 1
    return grids.Grid(4326, 10.0, 50.0, 0.01, 0.01, 40, rows) if srid == 4326 else grids.Grid(32631, 0.0, 0.0, 1.0, 1.0, 40, rows)


query("pixel_lookup", f"__p AS (SELECT s_suppkey AS id, CAST(floor((s_suppkey % 45 * 0.01 + 0.004) / 0.01) AS BIGINT) AS c0, CAST(floor((s_suppkey * 7 % 60 * 0.01 + 0.004) / 0.01) AS BIGINT) AS r0 FROM supplier) SELECT p.id, CASE WHEN r0 < h AND c0 < 40 THEN r0 END AS r, CASE WHEN r0 < h AND c0 < 40 THEN c0 END AS c, s.nir AS value, s.nir IS NULL AS nodata FROM __p p CROSS JOIN {_H} LEFT JOIN scene_cells s ON s.c = p.c0 AND s.r = p.r0", "scene_cells")(
    lambda s, d: grids.pixel_lookup(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (10.0 + F.col("s_suppkey") % 45 * 0.01 + 0.004).alias("lon"), (50.0 - F.col("s_suppkey") * 7 % 60 * 0.01 - 0.004).alias("lat")), _scene(s, d), _grid(s, d), "nir").select("id", "r", "c", "value", "nodata")
)
# Lookup table: the output cell (r, c) takes the sensor cell it names, counted from 1; 0 is no data.
query("glt_ortho", "SELECT g.r, g.c, s.nir AS value FROM (SELECT r, c, (r * 7 + c) % 6 AS gy, (c * 3 + r) % 41 AS gx FROM scene_cells) g LEFT JOIN scene_cells s ON g.gx > 0 AND g.gy > 0 AND s.r = g.gy - 1 AND s.c = g.gx - 1", "scene_cells")(
    lambda s, d: grids.ortho_by_lookup(_scene(s, d).selectExpr("r", "c", "(r * 7 + c) % 6 as gy", "(c * 3 + r) % 41 as gx"), _scene(s, d), ["nir"]).select("r", "c", F.col("nir").alias("value"))
)
# The middle of the scene by shares, halved.
query("crop_norm", f"__b AS (SELECT CAST(floor(0.25 * h + 1e-9) AS BIGINT) AS r0, CAST(ceil(0.75 * h - 1e-9) AS BIGINT) AS r1, h FROM {_H}), __k AS (SELECT s.r - r0 AS i, s.c - 10 AS j, s.nir, greatest(1.0, greatest(20, r1 - r0) / 16.0) AS step FROM scene_cells s, __b WHERE s.r >= r0 AND s.r < r1 AND s.c >= 10 AND s.c < 30) SELECT CAST(floor(i / step) AS BIGINT) AS r, CAST(floor(j / step) AS BIGINT) AS c, round_even(avg(nir), 6) AS value FROM __k GROUP BY ALL", "scene_cells")(
    lambda s, d: grids.crop(_scene(s, d), _grid(s, d), (0.25, 0.25, 0.75, 0.75), ["nir"], most=16)[0].select("r", "c", F.bround("nir", 6).alias("value"))
)
_G = "__g AS (SELECT r, c, (r + 0.5) * 2.5 AS y, (c + 0.5) * 2.5 AS x FROM (SELECT unnest(range(CAST(ceil(h / 2.5) AS BIGINT))) AS r FROM " + _H + "), (SELECT unnest(range(16)) AS c))"


def _resampled(method):
    def run(spark, sf_dir):
        grid = _grid(spark, sf_dir, 32631)
        target = grids.Grid(32631, 0.0, 0.0, 2.5, 2.5, 16, -(-grid.height * 2 // 5))
        return grids.align_to(_scene(spark, sf_dir), grid, target, ["nir"], method).select("r", "c", F.bround("nir", 6).alias("value"))

    return run


_KEYS = lambda t: f"CASE WHEN abs({t}) <= 1 THEN 1.5 * pow(abs({t}), 3) - 2.5 * pow({t}, 2) + 1 WHEN abs({t}) < 2 THEN -0.5 * pow(abs({t}), 3) + 2.5 * pow({t}, 2) - 4 * abs({t}) + 2 ELSE 0 END"
query("align_nearest", f"{_G} SELECT g.r, g.c, s.nir AS value FROM __g g LEFT JOIN scene_cells s ON s.r = floor(y) AND s.c = floor(x)", "scene_cells")(_resampled("nearest"))
query("align_bilinear", f"{_G}, __n AS (SELECT g.r, g.c, greatest(0.0, 1 - abs(y - 0.5 - s.r)) * greatest(0.0, 1 - abs(x - 0.5 - s.c)) AS w, nir FROM __g g JOIN scene_cells s ON abs(y - 0.5 - s.r) < 1 AND abs(x - 0.5 - s.c) < 1 WHERE nir IS NOT NULL) SELECT g.r, g.c, round_even(sum(w * nir) / nullif(sum(w), 0), 6) AS value FROM __g g LEFT JOIN __n n ON n.r = g.r AND n.c = g.c GROUP BY g.r, g.c", "scene_cells")(_resampled("bilinear"))
query("align_cubic", f"{_G}, __n AS (SELECT g.r, g.c, ({_KEYS('(y - 0.5 - s.r)')}) * ({_KEYS('(x - 0.5 - s.c)')}) AS w, nir FROM __g g JOIN scene_cells s ON abs(y - 0.5 - s.r) < 2 AND abs(x - 0.5 - s.c) < 2 WHERE nir IS NOT NULL) SELECT g.r, g.c, round_even(sum(w * nir) / nullif(sum(w), 0), 6) AS value FROM __g g LEFT JOIN __n n ON n.r = g.r AND n.c = g.c GROUP BY g.r, g.c", "scene_cells")(_resampled("cubic"))
_INSIDE = "__s AS (SELECT CAST(floor((r + 0.5) / 2.5) AS BIGINT) AS r, CAST(floor((c + 0.5) / 2.5) AS BIGINT) AS c, nir FROM scene_cells)"
query("align_average", f"{_G}, {_INSIDE}, __a AS (SELECT r, c, avg(nir) AS v FROM __s GROUP BY r, c) SELECT g.r, g.c, round_even(v, 6) AS value FROM __g g LEFT JOIN __a USING (r, c)", "scene_cells")(_resampled("average"))
query("align_mode", f"{_G}, {_INSIDE}, __c AS (SELECT r, c, nir, row_number() OVER (PARTITION BY r, c ORDER BY count(*) DESC, nir) AS k FROM __s WHERE nir IS NOT NULL GROUP BY r, c, nir) SELECT g.r, g.c, round_even(nir, 6) AS value FROM __g g LEFT JOIN __c ON __c.r = g.r AND __c.c = g.c AND k = 1", "scene_cells")(_resampled("mode"))
# Two rasters in degrees, the second with another origin, on one Mercator grid of 1,500 m; the second wins where it has data.
_EDGE = "6378137.0"
_MX = lambda lon: f"radians({lon}) * {_EDGE}"
_MY = lambda lat: f"ln(tan(pi() / 4 + radians({lat}) / 2)) * {_EDGE}"
_WARP = f"""__k AS (SELECT {_MX('10.0')} AS w, {_MX('10.455')} AS e, {_MY('50.0')} AS n, {_MY('50.0 - 0.01 * h - 0.0025')} AS s, h FROM {_H}),
__t AS (SELECT r, c, degrees((w + (c + 0.5) * 1500.0) / {_EDGE}) AS lon, degrees(2 * atan(exp((n - (r + 0.5) * 1500.0) / {_EDGE})) - pi() / 2) AS lat FROM (SELECT *, unnest(range(CAST(ceil((n - s) / 1500.0 - 1e-9) AS BIGINT))) AS r FROM __k) , (SELECT unnest(range((SELECT CAST(ceil((e - w) / 1500.0 - 1e-9) AS BIGINT) FROM __k))) AS c))
SELECT t.r, t.c, coalesce(b.nir, a.red) AS value FROM __t t LEFT JOIN scene_cells a ON a.r = floor((50.0 - lat) / 0.01) AND a.c = floor((lon - 10.0) / 0.01) LEFT JOIN scene_cells b ON b.r = floor((49.9975 - lat) / 0.01) AND b.c = floor((lon - 10.055) / 0.01)"""


@query("warp_mosaic", _WARP, "scene_cells")
def warp_mosaic(spark, sf_dir):
    scene, grid = _scene(spark, sf_dir), _grid(spark, sf_dir)
    moved = grids.Grid(4326, 10.055, 49.9975, 0.01, 0.01, 40, grid.height)
    sources = [(scene.select("r", "c", F.col("red").alias("value")), grid), (scene.select("r", "c", F.col("nir").alias("value")), moved)]
    return grids.warp(sources, ["value"], 3857, 1500.0, "nearest")[0].select("r", "c", "value")


# The scene in degrees on a UTM grid of 800 m.
@query("align_utm")
def align_utm(spark, sf_dir):
    scene, grid = _scene(spark, sf_dir), _grid(spark, sf_dir)
    target = grids.common_grid([grid], 32632, 800.0)
    return grids.align_to(scene, grid, target, ["red", "nir"], "nearest").select("r", "c", "red", "nir")


query("mosaic", "SELECT r, c, coalesce(b, a) AS value FROM (SELECT r, c, nir AS a, CASE WHEN c >= 20 THEN red END AS b FROM scene_cells) WHERE coalesce(b, a) IS NOT NULL", "scene_cells")(
    lambda s, d: ops.mosaic([_scene(s, d).select("r", "c", F.col("nir").alias("value")), _scene(s, d).filter("c >= 20").select("r", "c", F.col("red").alias("value"))])
)


_N = "0.0016792203863837047"  # f / (2 - f) of WGS84
_XI, _ETA = "atan2(t, cos(lam))", "atanh(sin(lam) / sqrt(1 + t * t))"
_ALPHA = (f"({_N} / 2 - 2 * pow({_N}, 2) / 3 + 5 * pow({_N}, 3) / 16)", f"(13 * pow({_N}, 2) / 48 - 3 * pow({_N}, 3) / 5)", f"(61 * pow({_N}, 3) / 240)")
_E = f"(2 * sqrt({_N}) / (1 + {_N}))"
_RADIUS = f"(0.9996 * 6378137.0 / (1 + {_N}) * (1 + pow({_N}, 2) / 4 + pow({_N}, 4) / 64))"
_UTM = f"__u AS (SELECT item_id, west, south, radians(west - 3) AS lam, sinh(atanh(sin(radians(south))) - {_E} * atanh({_E} * sin(radians(south)))) AS t FROM stac_items), __v AS (SELECT *, {_XI} AS xi, {_ETA} AS eta FROM __u)"
_EAST = " + ".join(f"{a} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))
_NORTH = " + ".join(f"{a} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))


@query("reproject", f"{_UTM} SELECT item_id, round_even({_MX('west')}, 4) AS x, round_even({_MY('south')}, 4) AS y, round_even(500000.0 + {_RADIUS} * (eta + {_EAST}), 4) AS easting, round_even({_RADIUS} * (xi + {_NORTH}), 4) AS northing, round_even(west, 7) AS lon, round_even(south, 7) AS lat FROM __v", "stac_items")
def reproject(spark, sf_dir):
    """Scene corners in Mercator and UTM 31 coordinates, and back from these."""
    items = view(spark, sf_dir, "stac_items")
    mx, my = grids.from_lonlat(F.col("west"), F.col("south"), 3857)
    e, n = grids.from_lonlat(F.col("west"), F.col("south"), 32631)
    rows = items.select("item_id", mx.alias("x"), my.alias("y"), e.alias("easting"), n.alias("northing"))
    lon, lat = grids.to_lonlat(F.col("easting"), F.col("northing"), 32631)
    return rows.select("item_id", *[F.bround(k, 4).alias(k) for k in ("x", "y", "easting", "northing")], F.bround(lon, 7).alias("lon"), F.bround(lat, 7).alias("lat"))


@query("scan_geojson", "SELECT zone_id, zone_name, round_even(abs(x0 * (y1 - y2) + x1 * (y2 - y0) + x2 * (y0 - y1)) / 2, 6) AS area FROM zones", "zones")
def scan_geojson(spark, sf_dir):
    """Zones written as a GeoJSON file and read from it."""
    path = new_folder(spark)
    geojson.write_geojson(zones(spark, sf_dir), path)
    return geojson.read_geojson(spark, path, "zone_id long, zone_name string", lines=True).select("zone_id", "zone_name", F.bround(ops.ring_area("rings"), 6).alias("area"))


def _boxes(name):
    """Boxes of a view as polygons."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("west", "south"), p("east", "south"), p("east", "north"), p("west", "north"))
    return lambda s, d: view(s, d, name).select(F.col("id"), F.array(ring).alias("rings"))


_MEET = {
    "intersects": "a.west <= b.east AND b.west <= a.east AND a.south <= b.north AND b.south <= a.north",
    "within": "a.west >= b.west AND a.east <= b.east AND a.south >= b.south AND a.north <= b.north",
    "contains": "a.west <= b.west AND a.east >= b.east AND a.south <= b.south AND a.north >= b.north",
}
for _how, _predicate in (("inner", "intersects"), ("left", "within"), ("right", "intersects"), ("inner", "contains")):
    _l, _r = ("service_areas", "footprints") if _predicate == "contains" else ("footprints", "service_areas")
    query(f"sjoin_{_how}_{_predicate}", f"SELECT a.id AS left_id, b.id AS right_id FROM {_l} a {_how} JOIN {_r} b ON {_MEET[_predicate]}", ("footprints", "service_areas"))(
        lambda s, d, h=_how, p=_predicate, l=_l, r=_r: ops.spatial_join(_boxes(l)(s, d).withColumnRenamed("id", "left_id"), _boxes(r)(s, d).withColumnRenamed("id", "right_id"), "left_id", "right_id", h, p)
    )
