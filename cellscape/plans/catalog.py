"""Queries on catalogs (sections A, B, C, D, I, E16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscape.functions import catalog as fn
from cellscape.operators import catalog as ops
from cellscape.operators import inspection
from cellscape.operators.vector import triangle
from cellscape.plans.fixtures import table, view
from cellscape.plans.registry import query

_r = lambda s, d: view(s, d, "rasters")
_items = lambda s, d: view(s, d, "stac_items")
_bands = lambda s, d: view(s, d, "band_catalog")
_instruments = lambda s, d: view(s, d, "instrument_bands")
SENSOR = r"CASE WHEN regexp_matches(replace(lower(platform), '_', '-'), 'sentinel-?1|\bs1[ab]\b') THEN 'sentinel1' WHEN regexp_matches(replace(lower(platform), '_', '-'), 'sentinel-?2|\bs2[ab]\b|msil2a|msil1c') THEN 'sentinel2' WHEN contains(replace(lower(platform), '_', '-'), 'landsat') THEN 'landsat' END"
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fn.NAME_ROLES.items())
_CODES = " ".join(f"WHEN '{s}:{c}' THEN '{r}'" for s, codes in fn.CODE_ROLES.items() for c, r in codes.items())
ROLE = f"coalesce(CASE lower(trim(label)) {_NAMES} END, nullif(regexp_extract(lower(trim(label)), '(?:^|[^a-z])(vv|vh|hh|hv)(?:$|[^a-z])', 1), ''), CASE {SENSOR} || ':B' || regexp_extract(lower(trim(label)), '^b0*(\\d+)$', 1) {_CODES} END)"
NM = r"CASE WHEN lower(regexp_extract(wavelength_text, '([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)', 2)) = 'nm' THEN v WHEN lower(regexp_extract(wavelength_text, '([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)', 2)) = 'um' THEN v * 1000.0 WHEN v BETWEEN 300 AND 2600 THEN v WHEN v BETWEEN 0.3 AND 2.6 THEN v * 1000.0 END"
_V = r"(SELECT *, CAST(nullif(regexp_extract(wavelength_text, '([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)', 1), '') AS DOUBLE) AS v FROM rasters)"


def _with_role(spark, sf_dir):
    return _r(spark, sf_dir).withColumn("sensor", fn.detect_sensor(F.col("platform"))).withColumn("role", fn.label_role(F.col("label"), F.col("sensor")))


query("detect_sensor", f"SELECT raster_id, {SENSOR} AS sensor FROM rasters", "rasters")(lambda s, d: _r(s, d).select("raster_id", fn.detect_sensor(F.col("platform")).alias("sensor")))
query("label_role", f"SELECT raster_id, {ROLE} AS role FROM rasters", "rasters")(lambda s, d: _with_role(s, d).select("raster_id", "role"))
query("infer_roles", f"__g AS (SELECT {ROLE} AS role, list(raster_id ORDER BY raster_id) AS bands FROM rasters GROUP BY 1), __r AS (SELECT unnest({list(fn.ROLES)}) AS role) SELECT role, CASE WHEN bands IS NULL THEN 'missing' WHEN len(bands) = 1 THEN 'found' ELSE 'ambiguous' END AS status, coalesce(bands, []) AS bands FROM __r LEFT JOIN __g USING (role)", "rasters")(
    lambda s, d: ops.infer_roles(_with_role(s, d).select(F.col("raster_id").alias("band"), "role"))
)
query("parse_wavelength", f"SELECT raster_id, {NM} AS nm FROM {_V}", "rasters")(lambda s, d: _r(s, d).select("raster_id", fn.wavelength_nm(F.col("wavelength_text")).alias("nm")))
query("band_wavelengths", f"__w AS (SELECT raster_id, {NM} AS nm FROM {_V}) SELECT raster_id, coalesce(nm, CAST(400 + 32 * (raster_id % 64) AS DOUBLE)) AS nm, nm IS NULL AS from_catalog FROM __w", "rasters")(
    lambda s, d: _r(s, d).withColumn("nm0", fn.wavelength_nm(F.col("wavelength_text"))).join(_bands(s, d), F.col("raster_id") % 64 == F.col("band")).select("raster_id", F.coalesce("nm0", F.col("wl_nm").cast("double")).alias("nm"), F.col("nm0").isNull().alias("from_catalog"))
)
query("bad_bands", "SELECT band, NOT (wl_nm BETWEEN 1340 AND 1460 OR wl_nm BETWEEN 1790 AND 1960) AND wl_nm BETWEEN 420 AND 2300 AS good FROM instrument_bands", "instrument_bands")(lambda s, d: _instruments(s, d).select("band", fn.good_band(F.col("wl_nm").cast("double"), valid=(420.0, 2300.0)).alias("good")))
query("spectral_summary", "__s AS (SELECT wl_nm, lead(wl_nm) OVER (ORDER BY wl_nm) - wl_nm AS step FROM instrument_bands) SELECT count(*) AS n, CAST(min(wl_nm) AS DOUBLE) AS min_nm, CAST(max(wl_nm) AS DOUBLE) AS max_nm, quantile_cont(step, 0.5) AS median_step, count(*) FILTER (NOT (wl_nm BETWEEN 1340 AND 1460 OR wl_nm BETWEEN 1790 AND 1960)) AS good, count(*) >= 15 AS hyperspectral FROM __s", "instrument_bands")(
    lambda s, d: inspection.spectral_summary(_instruments(s, d))
)
_DATE = r"""coalesce(
 CASE WHEN regexp_matches(date_text, '^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})') THEN try_cast(printf('%04d-%02d-%02d', CAST(regexp_extract(date_text, '^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})', 1) AS INT), CAST(regexp_extract(date_text, '^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})', 2) AS INT), CAST(regexp_extract(date_text, '^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})', 3) AS INT)) AS DATE) END,
 CASE WHEN p1 IS NOT NULL THEN try_cast(printf('%04d-%02d-%02d', y, CASE WHEN p2 > 12 AND p1 <= 12 THEN p1 ELSE p2 END, CASE WHEN p2 > 12 AND p1 <= 12 THEN p2 ELSE p1 END) AS DATE) END, DATE '2000-01-01')"""
_PARTS = r"(SELECT *, CAST(nullif(regexp_extract(date_text, '^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})', 1), '') AS INT) AS p1, CAST(nullif(regexp_extract(date_text, '^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})', 2), '') AS INT) AS p2, CAST(nullif(regexp_extract(date_text, '^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})', 3), '') AS INT) AS y FROM rasters)"
query("normalize_date", f"SELECT raster_id, CAST({_DATE} AS VARCHAR) AS date FROM {_PARTS}", "rasters")(lambda s, d: _r(s, d).select("raster_id", fn.normalized_date(F.col("date_text"), F.lit("2000-01-01").cast("date")).cast("string").alias("date")))


def _edges():
    return inspection.edges().values()


@query("cell_size", "SELECT raster_id, round_even(CASE WHEN srid = 4326 THEN greatest(dx * 111320.0 * cos(radians(greatest(-85.0, least(85.0, (y0 - height * dy + y0) / 2)))), 1.0) ELSE greatest(dx, 0.1) END, 6) AS dx_m, round_even(CAST(CASE WHEN srid = 4326 THEN greatest(dy * 110574.0, 1.0) ELSE greatest(dy, 0.1) END AS DOUBLE), 6) AS dy_m FROM rasters", "rasters")
def cell_size(spark, sf_dir):
    dx, dy = fn.cell_size(F.col("dx"), F.col("dy"), F.col("srid"), *_edges())
    return _r(spark, sf_dir).select("raster_id", F.bround(dx, 6).alias("dx_m"), F.bround(dy, 6).alias("dy_m"))


@query("native_grid", "__g AS (SELECT item_id, abs(east - west) * 111320.0 * greatest(0.1, cos(radians((south + north) / 2.0))) AS w, abs(north - south) * 110574.0 AS h, CASE WHEN collection = 'landsat-c2-l2' THEN 30.0 ELSE 10.0 END AS res FROM stac_items) SELECT item_id, round_even(w * h / 1e6, 2) AS area_km2, CAST(res AS DOUBLE) AS native_m, CAST(greatest(1, round_even(w / res, 0)) AS BIGINT) AS width_px, CAST(greatest(1, round_even(h / res, 0)) AS BIGINT) AS height_px, CAST(greatest(1, round_even(w / res, 0)) AS BIGINT) * CAST(greatest(1, round_even(h / res, 0)) AS BIGINT) <= 36000000 AS within_limit FROM __g", "stac_items")
def native_grid(spark, sf_dir):
    got = fn.native_grid(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("collection") == "landsat-c2-l2")
    return _items(spark, sf_dir).select("item_id", *[c.alias(k) for k, c in got.items()])


query("boa_offset", "__a AS (SELECT item_id, collection, dt, unnest(['B04', 'SCL']) AS asset, CASE item_id % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 2.9 END AS baseline FROM stac_items) SELECT item_id, asset, CASE WHEN collection = 'sentinel-2-l2a' AND asset <> 'SCL' AND coalesce(baseline >= 4, CAST(dt AS DATE) >= DATE '2022-01-25') THEN -1000 ELSE 0 END AS boa_offset FROM __a", "stac_items")(
    lambda s, d: _items(s, d).withColumn("asset", F.explode(F.array(F.lit("B04"), F.lit("SCL")))).withColumn("baseline", F.when(F.col("item_id") % 3 == 0, 4.0).when(F.col("item_id") % 3 == 1, 2.9)).select("item_id", "asset", fn.boa_offset(F.col("collection"), F.col("asset"), F.col("baseline"), F.col("dt").cast("date")).alias("boa_offset"))
)
# Each raster and the next one.
query("same_grid", "SELECT a.raster_id AS left, b.raster_id AS right, a.srid = b.srid AND a.width = b.width AND a.height = b.height AND abs(a.dx - b.dx) <= 1e-6 AND abs(a.dy - b.dy) <= 1e-6 AND abs(a.x0 - b.x0) <= 1e-6 AND abs(a.y0 - b.y0) <= 1e-6 AS same FROM rasters a JOIN rasters b ON a.raster_id + 1 = b.raster_id", "rasters")(
    lambda s, d: ops.same_grid(_r(s, d).withColumn("pair", F.col("raster_id") + 1), _r(s, d).withColumn("pair", F.col("raster_id")))
)
query("alignment", "__f AS (SELECT * FROM rasters ORDER BY raster_id LIMIT 1) SELECT r.raster_id, list_filter([CASE WHEN r.srid <> f.srid THEN 'crs' END, CASE WHEN greatest(abs(r.dx - f.dx), abs(r.dy - f.dy)) > 1e-6 THEN 'resolution' END, CASE WHEN r.width <> f.width OR r.height <> f.height THEN 'size' END, CASE WHEN greatest(abs(r.x0 - f.x0), abs(r.y0 - f.y0)) > 1e-6 THEN 'bounds' END], lambda x: x IS NOT NULL) AS differs FROM rasters r, __f f", "rasters")(lambda s, d: ops.alignment_report(_r(s, d)))
query("order_by_date", f"SELECT raster_id, CAST(rank() OVER (ORDER BY date) AS INT) AS place FROM (SELECT raster_id, {_DATE} AS date FROM {_PARTS})", "rasters")(
    lambda s, d: ops.order_by_date(_r(s, d).withColumn("t1", F.lit(None).cast("string")).withColumn("t2", fn.normalized_date(F.col("date_text"), F.lit("2000-01-01").cast("date")).cast("string")), ["t1", "t2"]).select("raster_id", "place")
)
_BOX = (2.0, 1.0, 4.0, 3.0)
_COV = "CASE WHEN least(4.0, east) > greatest(2.0, west) AND least(3.0, north) > greatest(1.0, south) THEN round_even(least(100.0, (least(4.0, east) - greatest(2.0, west)) * (least(3.0, north) - greatest(1.0, south)) / ((4.0 - 2.0) * (3.0 - 1.0)) * 100.0), 1) ELSE 0.0 END"
_FOUND = f"__s AS (SELECT *, {_COV} AS coverage FROM stac_items WHERE dt >= DATE '1993-01-01' AND dt <= DATE '1997-12-31' AND (cloud IS NULL OR cloud <= 60) AND (collection <> 'sentinel-2-l2a' OR nodata_pct <= 20))"
_search = lambda s, d: ops.search_scenes(_items(s, d), _BOX, "1993-01-01", "1997-12-31", 60.0)
query("stac_coverage", f"{_FOUND} SELECT item_id, coverage FROM __s", "stac_items")(lambda s, d: _search(s, d).select("item_id", "coverage"))
# Triangles over an item's box, for items with odd numbers.  In DuckDB: both shapes are convex, so their common part has as corners those of
# either that lie in the other, and the crossings of sides; its area by the corners in their order around the middle.
_TRIANGLE = """__t AS (SELECT item_id, west + 0.0137 AS ax, south + 0.0219 AS ay, east AS bx, south + 0.0313 AS by_, west + (item_id % 11) / 10.0 + 0.0071 AS cx, north AS cy FROM __s WHERE item_id % 2 = 1),
__side AS (SELECT item_id, ax AS px, ay AS py, bx AS qx, by_ AS qy FROM __t UNION ALL SELECT item_id, bx, by_, cx, cy FROM __t UNION ALL SELECT item_id, cx, cy, ax, ay FROM __t),
__corner AS (SELECT unnest([2.0, 4.0, 4.0, 2.0]) AS x, unnest([1.0, 1.0, 3.0, 3.0]) AS y),
__v AS (SELECT DISTINCT item_id, round(x, 12) AS x, round(y, 12) AS y FROM (
  SELECT item_id, px AS x, py AS y FROM __side WHERE px BETWEEN 2 AND 4 AND py BETWEEN 1 AND 3
  UNION ALL SELECT item_id, x, y FROM __side CROSS JOIN __corner GROUP BY item_id, x, y HAVING bool_and((qx - px) * (y - py) - (qy - py) * (x - px) >= 0)
  UNION ALL SELECT item_id, k, py + (k - px) / (qx - px) * (qy - py) FROM __side CROSS JOIN (SELECT unnest([2.0, 4.0]) AS k) WHERE qx <> px AND (k - px) / (qx - px) BETWEEN 0 AND 1 AND py + (k - px) / (qx - px) * (qy - py) BETWEEN 1 AND 3
  UNION ALL SELECT item_id, px + (k - py) / (qy - py) * (qx - px), k FROM __side CROSS JOIN (SELECT unnest([1.0, 3.0]) AS k) WHERE qy <> py AND (k - py) / (qy - py) BETWEEN 0 AND 1 AND px + (k - py) / (qy - py) * (qx - px) BETWEEN 2 AND 4)),
__o AS (SELECT item_id, x, y, atan2(y - avg(y) OVER w, x - avg(x) OVER w) AS turn, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM __v WINDOW w AS (PARTITION BY item_id)),
__n AS (SELECT *, coalesce(lead(x) OVER u, first_value(x) OVER u) AS nx, coalesce(lead(y) OVER u, first_value(y) OVER u) AS ny FROM __o WINDOW u AS (PARTITION BY item_id ORDER BY turn, x, y)),
__a AS (SELECT item_id, abs(sum(x * ny - nx * y)) / 2 AS area FROM __n GROUP BY item_id)"""
query("stac_footprints", f"{_FOUND}, {_TRIANGLE} SELECT item_id, CASE WHEN item_id % 2 = 0 THEN coverage ELSE round_even(least(100.0, coalesce(area, 0.0) / 4.0 * 100.0), 1) END AS coverage FROM __s LEFT JOIN __a USING (item_id)", "stac_items")(
    lambda s, d: ops.search_scenes(_items(s, d).withColumn("footprint", F.expr("CASE WHEN item_id % 2 = 1 THEN array(array(struct(west + 0.0137D AS x, south + 0.0219D AS y), struct(east AS x, south + 0.0313D AS y), struct(west + (item_id % 11) / 10D + 0.0071D AS x, north AS y), struct(west + 0.0137D AS x, south + 0.0219D AS y))) END")), _BOX, "1993-01-01", "1997-12-31", 60.0).select("item_id", "coverage")
)
query("rank_scenes", f"{_FOUND} SELECT item_id, coverage FROM __s ORDER BY coverage DESC, coalesce(cloud, 50), nodata_pct, item_id LIMIT 12", "stac_items")(lambda s, d: ops.rank_scenes(_search(s, d)).select("item_id", "coverage"))
query("coverage_gate", f"{_FOUND} SELECT item_id, NOT (coverage < 50 AND count(*) OVER (PARTITION BY dt) = 1) AS accepted FROM __s", "stac_items")(lambda s, d: ops.coverage_gate(_search(s, d)).select("item_id", "accepted"))
_NEED = " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in fn.REQUIRED_ASSETS.items())
query("required_assets", f"SELECT item_id, list_filter(['SCL', 'vv'] || list_filter(CASE collection {_NEED} END, lambda x: x NOT IN ('SCL', 'vv')), lambda x: x <> 'B05' AND x <> 'qa_pixel' AND (x <> 'SCL' OR collection <> 'sentinel-1-rtc')) AS assets FROM stac_items", "stac_items")(
    lambda s, d: ops.required_assets(_items(s, d).withColumn("requested", F.array(F.lit("SCL"), F.lit("vv"))).withColumn("has", F.filter(F.array(*map(F.lit, sorted({a for v in fn.REQUIRED_ASSETS.values() for a in v} - {"B05", "qa_pixel"}))), lambda a: (a != "SCL") | (F.col("collection") != "sentinel-1-rtc")))).select("item_id", "assets")
)
_GAZ = "SELECT c_custkey AS place_id, c_nationkey AS query, CASE c_custkey % 4 WHEN 0 THEN 'highway' WHEN 1 THEN 'place' WHEN 2 THEN 'natural' ELSE 'other' END AS cls, CASE c_custkey % 3 WHEN 0 THEN 'street' ELSE 'city' END AS typ, CAST(c_custkey % 17 AS DOUBLE) / 17 AS importance, CAST(c_custkey % 90 AS DOUBLE) AS lon, CAST(c_custkey % 60 AS DOUBLE) AS lat, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 90 - 0.1 * (c_custkey % 7) / 2 END AS west, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 60 - 0.05 * (c_custkey % 7) / 2 END AS south, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 90 + 0.1 * (c_custkey % 7) / 2 END AS east, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 60 + 0.05 * (c_custkey % 7) / 2 END AS north FROM {customer}"


def _gazetteer(spark, sf_dir):
    g = spark.sql(_GAZ, customer=table(spark, sf_dir, "customer"))
    return g.withColumns({k: F.col(k).cast("double") for k in ("west", "south", "east", "north")})


query("rank_places", f"WITH g AS ({_GAZ.replace('{customer}', 'customer')}), s AS (SELECT *, importance + CASE WHEN cls = 'highway' THEN -10.0 WHEN typ = 'street' THEN -8.0 WHEN cls IN ('place', 'natural') THEN 5.0 ELSE 0.0 END AS score FROM g), b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, place_id) AS n, CASE WHEN west IS NULL THEN 0.12 WHEN east - west > 0.45 OR north - south > 0.45 THEN 0.15 WHEN east - west < 0.02 OR north - south < 0.02 THEN 0.08 END AS half FROM s) SELECT query, place_id, score, round_even(CAST(coalesce(lon - half, west) AS DOUBLE), 5) AS west, round_even(CAST(coalesce(lat - half, south) AS DOUBLE), 5) AS south, round_even(CAST(coalesce(lon + half, east) AS DOUBLE), 5) AS east, round_even(CAST(coalesce(lat + half, north) AS DOUBLE), 5) AS north FROM b WHERE n = 1")(
    lambda s, d: ops.rank_places(_gazetteer(s, d))
)
_MON = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'][month(o_orderdate)]"
_YM = "year(o_orderdate) || '-' || lpad(month(o_orderdate)::VARCHAR, 2, '0')"
_TARGETS = f"SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'change_' || {_YM} || '_map' WHEN 1 THEN 'ndvi_' || replace({_YM}, '-', '_') || '_15' WHEN 2 THEN 'flood ' || {_MON} || year(o_orderdate) ELSE 'Cover-plot_' || o_orderpriority || '_plot' END AS target FROM orders"
_RASTERS = f"SELECT DISTINCT CASE o_custkey % 4 WHEN 0 THEN 'loss' || {_YM} WHEN 1 THEN 'scene_' || {_YM} || '-15' WHEN 2 THEN {_MON} || '_mosaic' || year(o_orderdate) % 5 ELSE 'cover-plot_' || lower(o_orderpriority) END AS raster FROM orders"
_WORDS = f"list_filter(list_distinct(regexp_split_to_array({{}}, '[-_.]+')), lambda x: x NOT IN {ops.EMPTY_WORDS})"
_DATES = r"list_distinct(flatten([[replace(d, '_', '-'), replace(d, '_', '-')[1:7]] FOR d IN regexp_extract_all({0}, '(?:^|[^0-9])([0-9]{{4}}[-_][0-9]{{2}}(?:[-_][0-9]{{2}})?)(?:$|[^0-9])', 1)]))"
_YEARS = r"list_filter(regexp_split_to_array({0}, '[^0-9]+'), lambda x: regexp_full_match(x, '(19|20)[0-9][0-9]'))"
_NAMES = rf"[{{0}}, regexp_replace({{0}}, '({'|'.join(ops.MAP_ENDS)})$', '')]"
_MONTHS_OF = "len(list_filter(range(12), lambda i: contains(t, " + str(list(ops.MONTHS)) + "[i + 1]) AND (contains(r, " + str(list(ops.MONTHS)) + "[i + 1]) OR contains(replace(r, '_', '-'), '-' || lpad((i + 1)::VARCHAR, 2, '0')))))"
_POINTS = " + ".join([
    f"CASE WHEN list_contains({_NAMES.format('t')}, r) OR list_contains({_NAMES.format('r')}, t) THEN 200 ELSE 0 END", f"CASE WHEN list_has_any({_DATES.format('t')}, {_DATES.format('r')}) THEN 100 ELSE 0 END",
    f"CASE WHEN list_has_any({_YEARS.format('t')}, {_YEARS.format('r')}) THEN 40 ELSE 0 END", f"CASE WHEN regexp_matches(t, '{'|'.join(ops.CHANGE_WORDS)}') AND regexp_matches(r, '{'|'.join(ops.CHANGE_WORDS)}') THEN 60 ELSE 0 END",
    f"30 * {_MONTHS_OF}", f"10 * len(list_intersect({_WORDS.format('t')}, {_WORDS.format('r')}))",
])


def _stems(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    mon = F.element_at(F.array(*map(F.lit, ops.MONTHS)), F.month("o_orderdate"))
    year, ym = F.year("o_orderdate").cast("string"), F.date_format("o_orderdate", "yyyy-MM")
    t = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("change_"), ym, F.lit("_map"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("ndvi_"), F.translate(ym, "-", "_"), F.lit("_15"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("flood "), mon, year))
    r = F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("loss"), ym)).when(F.col("o_custkey") % 4 == 1, F.concat(F.lit("scene_"), ym, F.lit("-15"))).when(F.col("o_custkey") % 4 == 2, F.concat(mon, F.lit("_mosaic"), (F.year("o_orderdate") % 5).cast("string")))
    targets = o.select(t.otherwise(F.concat(F.lit("Cover-plot_"), "o_orderpriority", F.lit("_plot"))).alias("target")).distinct()
    return targets, o.select(r.otherwise(F.concat(F.lit("cover-plot_"), F.lower("o_orderpriority"))).alias("raster")).distinct()


query("match_rasters", f"WITH a AS ({_TARGETS}), b AS ({_RASTERS}), p AS (SELECT target, raster, {_POINTS} AS points FROM (SELECT *, lower(target) AS t, lower(raster) AS r FROM a, b)) SELECT target, raster, CAST(points AS INT) AS points, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY points DESC, raster) AS INT) AS place FROM p WHERE points > 0) WHERE place <= 3")(
    lambda s, d: ops.match_rasters(*_stems(s, d))
)
_SB = ["blue", "green", "red", "nir"]
query("raster_summary", "__l AS (UNPIVOT (SELECT blue, green, red, nir FROM scene_cells) ON blue, green, red, nir INTO NAME band VALUE v) SELECT band, count(v) AS n, min(v) AS min, max(v) AS max, round_even(avg(v), 6) AS mean FROM __l GROUP BY band", "scene_cells")(lambda s, d: ops.raster_summary(view(s, d, "scene_cells"), _SB))
query("vector_summary", "SELECT 'Polygon' AS geom_type, count(*) AS n, min(least(x0, x1, x2)) AS west, min(least(y0, y1, y2)) AS south, max(greatest(x0, x1, x2)) AS east, max(greatest(y0, y1, y2)) AS north, 'EPSG:32631' AS crs, 'zone_id,zone_name' AS columns FROM zones", "zones")(
    lambda s, d: inspection.vector_summary(view(s, d, "zones").select("zone_id", "zone_name", triangle(*[F.col(f"{a}{k}") for k in range(3) for a in "xy"]).alias("rings")), 32631)
)
query("points_summary", "SELECT count(*) AS n, min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north, round_even(min(z), 2) AS z_min, round_even(max(z), 2) AS z_max FROM points", "points")(
    lambda s, d: inspection.points_summary(view(s, d, "points"))
)
query("raster_bounds", "SELECT raster_id, round_even(CASE WHEN srid = 4326 THEN x0 ELSE degrees(x0 / 6378137.0) END, 7) AS west, round_even(CASE WHEN srid = 4326 THEN y0 - height * dy ELSE degrees(2 * atan(exp((y0 - height * dy) / 6378137.0)) - pi() / 2) END, 7) AS south, round_even(CASE WHEN srid = 4326 THEN x0 + width * dx ELSE degrees((x0 + width * dx) / 6378137.0) END, 7) AS east, round_even(CASE WHEN srid = 4326 THEN y0 ELSE degrees(2 * atan(exp(y0 / 6378137.0)) - pi() / 2) END, 7) AS north FROM rasters", "rasters")(
    lambda s, d: inspection.raster_bounds(_r(s, d)).select("raster_id", *[F.bround(n, 7).alias(n) for n in ("west", "south", "east", "north")])
)
query("tile_grid", "__t AS (SELECT item_id AS image_id, west, south, east, north, unnest(range(0, 3)) AS tr FROM stac_items), __u AS (SELECT *, unnest(range(0, 2)) AS tc FROM __t) SELECT image_id, printf('T%d_%d', tr, tc) AS tile, west + (east - west) * tc / 2 AS west, north - (north - south) * (tr + 1) / 3 AS south, west + (east - west) * (tc + 1) / 2 AS east, north - (north - south) * tr / 3 AS north FROM __u", "stac_items")(
    lambda s, d: ops.tile_grid(_items(s, d).withColumnRenamed("item_id", "image_id"), 3, 2)
)
query("raster_quality", "__a AS (SELECT round_even(CAST(count(*) FILTER (nir IS NULL) AS DOUBLE) / count(*), 4) AS nodata, round_even(CAST(count(*) FILTER (scl IN (3, 8, 9, 10) AND nir IS NOT NULL) AS DOUBLE) / count(nir), 4) AS cloud FROM scene_cells) SELECT nodata, cloud, array_to_string(list_filter([CASE WHEN nodata > 0.2 THEN 'no-data' END, CASE WHEN cloud > 0.3 THEN 'cloud' END], lambda x: x IS NOT NULL), ',') AS warnings, CASE WHEN nodata >= 0.6 OR cloud >= 0.7 THEN 'insufficient_data' ELSE 'ok' END AS verdict FROM __a", "scene_cells")(
    lambda s, d: ops.raster_quality(view(s, d, "scene_cells"), "nir", "scl")
)
query("quality_gate", "__a AS (SELECT CAST(count(*) FILTER (nir IS NULL) AS DOUBLE) / count(*) AS nodata, CAST(count(*) FILTER (scl IN (3, 8, 9, 10) AND nir IS NOT NULL) AS DOUBLE) / count(nir) AS c1, CAST(count(*) FILTER (qa60 & 3072 <> 0 AND nir IS NOT NULL) AS DOUBLE) / count(nir) AS c2, CAST(count(*) FILTER (nir IS NOT NULL AND scl NOT IN (3, 8, 9, 10) AND qa60 & 3072 = 0) AS DOUBLE) / count(*) AS both_ok FROM scene_cells) SELECT CASE WHEN nodata >= 0.6 OR c1 >= 0.7 OR c2 >= 0.7 OR both_ok < 0.15 THEN 'insufficient_data' ELSE 'ok' END AS verdict FROM __a", "scene_cells")(
    lambda s, d: _gate(view(s, d, "scene_cells"))
)


def _gate(cells):
    from cellscape.operators.cells import cloud_flag

    each = ops.raster_quality(cells, "nir", "scl").unionByName(ops.raster_quality(cells, "nir", "qa"))
    mutual = cells.agg((F.count_if(F.col("nir").isNotNull() & ~cloud_flag("scl") & ~cloud_flag("qa")) / F.count("*")).alias("share"))
    return inspection.quality_gate(each, mutual).select("verdict")


@query("dataset_report", "SELECT 'raster' AS kind, count(*) AS n FROM rasters UNION ALL SELECT 'points', count(*) FROM points UNION ALL SELECT 'vector', count(*) FROM zones", ("rasters", "points", "zones"))
def dataset_report(spark, sf_dir):
    parts = [view(spark, sf_dir, v).agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, v in (("raster", "rasters"), ("points", "points"), ("vector", "zones"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("file_inspect")
def file_inspect(spark, sf_dir):
    """Files of the table folder by kind and size."""
    return inspection.file_kinds(spark, sf_dir).select("name", "kind", F.col("bytes").alias("length"))


query("timeline", "__f AS (SELECT CAST(ts AS DATE) AS d, round_even(avg(value), 4) AS v FROM events GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS index, CAST(d AS VARCHAR) AS date, v AS value, CAST(d AS VARCHAR) || ': ' || CAST(CAST(floor(v) AS BIGINT) AS VARCHAR) || ' ha' AS label, min(v) OVER () AS low, max(v) OVER () AS high FROM __f", "dates")(
    lambda s, d: inspection.timeline(table(s, d, "events").groupBy(F.col("ts").cast("date").alias("d")).agg(F.bround(F.avg("value"), 4).alias("v")), unit="ha")
)
query("companion_check", "SELECT DISTINCT o_custkey AS stem FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 1")(
    lambda s, d: inspection.companion_check(*[table(s, d, "orders").filter(f"o_orderkey % 2 = {k}").select(F.col("o_custkey").alias("stem")) for k in (0, 1)], "stem")
)
# A raster of each supplier with one band; a fifth of them without a system.
_REPORT = f"__n AS (SELECT *, {ROLE} AS role, {SENSOR} AS sensor, CASE WHEN raster_id % 5 <> 0 THEN srid END AS system FROM rasters) SELECT raster_id, width, height, 1 AS band_count, role, sensor, date_text AS date, 'EPSG:' || system AS crs, dx, dy, CASE WHEN system = 4326 THEN 'degrees' WHEN system IS NOT NULL THEN 'metre' END AS resolution_units, CASE WHEN system <> 4326 THEN round_even(CAST(width * height * dx * dy / 1e6 AS DOUBLE), 3) END AS extent_km2, CAST(x0 AS DOUBLE) AS west, CAST(y0 - height * dy AS DOUBLE) AS south, -9999.0 AS nodata, CASE WHEN system IS NULL THEN 'no coordinate system' END AS error FROM __n"


def _report(spark, sf_dir):
    r = _r(spark, sf_dir)
    tags = F.create_map(F.lit("platform"), F.col("platform"), F.lit("ACQUISITION_DATETIME"), F.col("date_text"))
    bands = r.select("raster_id", F.lit(1).alias("band"), "label", F.lit(-9999.0).alias("nodata"))
    got = inspection.raster_report(r.withColumn("tags", tags).withColumn("srid", F.when(F.col("raster_id") % 5 != 0, F.col("srid"))), bands)
    return got.select("raster_id", "width", "height", "band_count", F.col("bands")[0]["role"].alias("role"), "sensor", "date", "crs", F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"), "resolution_units", "extent_km2", F.col("west").cast("double").alias("west"), F.col("south").cast("double").alias("south"), "nodata", "error")


query("raster_report", _REPORT, "rasters")(_report)
# Three bands of each supplier's raster: wavelengths listed by the raster, tagged by band, or in the description.
_WAVES = """__b AS (SELECT s_suppkey AS raster_id, unnest([1, 2, 3]) AS band FROM supplier),
__w AS (SELECT raster_id, band, CASE raster_id % 4 WHEN 0 THEN CAST(400 + 10 * band + raster_id % 100 AS DOUBLE) WHEN 1 THEN 500.0 + band WHEN 2 THEN CASE band WHEN 1 THEN 665.0 WHEN 2 THEN 842.0 END ELSE 1000.0 * (0.5 + band / 10.0) END AS nm FROM __b)
SELECT raster_id, band, round_even(nm, 6) AS nm, CASE WHEN nm IS NULL THEN NULL WHEN raster_id % 4 = 3 THEN 'assumed_um' WHEN raster_id % 4 = 0 THEN 'assumed_nm' ELSE 'explicit_unit' END AS source FROM __w"""


def _waves(spark, sf_dir):
    none = F.create_map().cast("map<string,string>")
    k, b = F.col("raster_id"), F.col("band")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("raster_id"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("band"))
    listed = F.concat_ws(", ", *[(F.lit(400 + 10 * i) + k % 100).cast("string") for i in (1, 2, 3)])
    rows = rows.withColumns({
        "tags": F.when(k % 4 == 0, F.create_map(F.lit("wavelengths"), F.concat(F.lit("{"), listed, F.lit("}")))).otherwise(none),
        "band_tags": F.when(k % 4 == 1, F.create_map(F.lit("wavelength_nm"), (F.lit(500) + b).cast("string"))).otherwise(none),
        "description": F.when(k % 4 == 2, F.when(b == 1, "Red 665 nm").when(b == 2, "0.842 um")).when(k % 4 == 3, F.format_string("%.1f", 0.5 + b / 10)),
    })
    return inspection.band_wavelengths(rows, allow_missing=True).withColumn("nm", F.bround("nm", 6))


query("wavelength_sources", f"WITH {_WAVES}")(_waves)
_SCL = "0: no data; 3 = cloud shadow; 4 - vegetation, 5 bare soils (6: water"
query("class_profile", "SELECT scl AS value, CASE scl WHEN 0 THEN 'No data' WHEN 3 THEN 'Cloud shadow' WHEN 4 THEN 'Vegetation' WHEN 5 THEN 'Bare soils' WHEN 6 THEN 'Water' WHEN 8 THEN 'Cloud' END AS label, count(*) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM scene_cells GROUP BY scl", "scene_cells")(
    lambda s, d: inspection.class_profile(view(s, d, "scene_cells"), "scl", inspection.class_labels(F.create_map(F.lit("class_8"), F.lit("cloud")), F.lit(_SCL)))
)
