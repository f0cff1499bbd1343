"""Queries on neighbourhoods (section G, A16, A17, E11, C13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscape.operators import focal as ops
from cellscape.plans.fixtures import view
from cellscape.plans.registry import query

def dem(spark, sf_dir):
    """The elevation grid as a whole rectangle; cells beyond the last part row are missing."""
    return view(spark, sf_dir, "dem_grid")


def nir(spark, sf_dir):
    return view(spark, sf_dir, "scene_cells").select("r", "c", F.col("nir").alias("z"))


_DEM = "__z AS (SELECT * FROM dem_grid)"
_EDGE = {
    "replicate": lambda x, n: f"greatest(0, least({n} - 1, {x}))",
    "mirror": lambda x, n: f"CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} >= {n} THEN 2 * {n} - 1 - ({x}) ELSE {x} END",
    "wrap": lambda x, n: f"(({x}) + {n}) % {n}",
}


def _near(size: int, edge: str, fill: str) -> str:
    """DuckDB: (r, c, z, dr, dc, v) by joining each cell with its neighbours' coordinates."""
    k, e = size // 2, _EDGE[edge]
    return f"""__h AS (SELECT max(r) + 1 AS h, {fill} AS fill FROM __z),
__o AS (SELECT a.r, a.c, a.z, dr, dc, {e('a.r + dr', 'h')} AS rr, {e('a.c + dc', '40')} AS cc, fill FROM __z a, __h, (SELECT unnest(range(-{k}, {k} + 1)) AS dr), (SELECT unnest(range(-{k}, {k} + 1)) AS dc)),
__n AS (SELECT o.r, o.c, o.z, o.dr, o.dc, coalesce(b.z, o.fill) AS v, b.z AS raw FROM __o o JOIN __z b ON b.r = o.rr AND b.c = o.cc) """


_MEDIAN, _MEAN, _NONE = "quantile_cont(z, 0.5)", "avg(z)", "CAST(NULL AS DOUBLE)"
_GX = "sum(v * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END)"
_GY = "sum(v * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END)"
_SOBEL = f"__s AS (SELECT r, c, z, {_GX} / 80.0 AS p, {_GY} / 80.0 AS q FROM __n GROUP BY r, c, z)"
_base = lambda size, edge, fill: f"{_DEM}, {_near(size, edge, fill)}"
_6 = lambda df: df.select("r", "c", F.bround("value", 6).alias("value"))
_V = ("dem_grid",)
query("gradient", f"{_base(3, 'mirror', _MEAN)} SELECT r, c, round_even(CASE WHEN z IS NOT NULL THEN sqrt({_GX} * {_GX} + {_GY} * {_GY}) END, 6) AS value FROM __n GROUP BY r, c, z", _V)(lambda s, d: _6(ops.gradient(dem(s, d), "z")))
query("slope", f"{_base(3, 'replicate', _MEDIAN)}, {_SOBEL} SELECT r, c, round_even(CASE WHEN z IS NOT NULL THEN degrees(atan(sqrt(p * p + q * q))) END, 6) AS value FROM __s", _V)(lambda s, d: _6(ops.slope(dem(s, d), "z", 10.0, 10.0)))
query("aspect", f"{_base(3, 'replicate', _MEDIAN)}, {_SOBEL} SELECT r, c, round_even(CASE WHEN z IS NULL THEN NULL WHEN degrees(atan(sqrt(p * p + q * q))) < 0.5 THEN -1 ELSE (180 - degrees(atan2(q, -p)) + 360) % 360 END, 6) AS value FROM __s", _V)(lambda s, d: _6(ops.aspect(dem(s, d), "z", 10.0, 10.0)))
_LIGHT = " + ".join(f"{w} * greatest(0.0, cos(radians(45)) * cos(atan(sqrt(p * p + q * q))) + sin(radians(45)) * sin(atan(sqrt(p * p + q * q))) * cos(radians({(450 - a) % 360}) - atan2(q, -p)))" for a, w in ((315, 0.40), (225, 0.25), (45, 0.25), (135, 0.10)))
query("hillshade", f"{_base(3, 'replicate', _MEDIAN)}, {_SOBEL} SELECT r, c, CASE WHEN z IS NULL THEN 0 ELSE CAST(floor(greatest(0.0, least(255.0, ({_LIGHT}) * 255.0))) AS INT) END AS value FROM __s", _V)(lambda s, d: ops.hillshade(dem(s, d), "z", 10.0, 10.0))
query("tri", f"{_base(3, 'replicate', _NONE)} SELECT r, c, round_even(CASE WHEN count(raw) = 9 THEN sqrt(sum((raw - z) * (raw - z)) / 8.0) END, 6) AS value FROM __n GROUP BY r, c, z", _V)(lambda s, d: _6(ops.ruggedness(dem(s, d), "z")))
query("tpi", f"{_base(5, 'replicate', _MEDIAN)} SELECT r, c, round_even(CASE WHEN z IS NOT NULL THEN z - avg(v) END, 6) AS value FROM __n GROUP BY r, c, z", _V)(lambda s, d: _6(ops.position_index(dem(s, d), "z", 5)))
query("speckle", f"{_base(5, 'mirror', _NONE)} SELECT r, c, round_even(CASE WHEN z IS NOT NULL THEN avg(raw) END, 6) AS value FROM __n GROUP BY r, c, z", _V)(lambda s, d: _6(ops.speckle_filter(dem(s, d), "z", 5)))
query("texture", f"__z AS (SELECT r, c, coalesce(z, 0) AS z FROM dem_grid), {_near(5, 'mirror', _NONE)} SELECT r, c, round_even(sqrt(greatest(0.0, avg(v * v) - avg(v) * avg(v))), 5) AS value FROM __n GROUP BY r, c", _V)(
    lambda s, d: ops.texture(dem(s, d).withColumn("z", F.coalesce("z", F.lit(0.0))), "z", 5).select("r", "c", F.bround("value", 5).alias("value"))
)
query("median3", f"{_base(3, 'mirror', _NONE)} SELECT r, c, CASE WHEN count(raw) > 0 THEN list_sort(list(raw) FILTER (raw IS NOT NULL))[CAST(floor(count(raw) / 2) AS INT) + 1] END AS value FROM __n GROUP BY r, c", _V)(lambda s, d: ops.median3(dem(s, d), "z"))
query("lbp", f"{_base(3, 'wrap', _NONE)} SELECT r, c, CAST(count(*) FILTER (raw <= z AND NOT (dr = 0 AND dc = 0)) AS INT) AS value FROM __n GROUP BY r, c", _V)(lambda s, d: ops.lbp(dem(s, d), "z"))
query("overview", f"{_DEM}, __h AS (SELECT CAST(max(r) + 1 AS DOUBLE) AS h FROM __z), __g AS (SELECT CAST(floor(r * least(16, h) / h) AS BIGINT) AS r2, CAST(floor(c * 16 / 40.0) AS BIGINT) AS c2, avg(z) AS z FROM __z, __h GROUP BY 1, 2) SELECT r2 AS r, c2 AS c, round_even(coalesce(z, min(z) OVER ()), 1) AS z FROM __g", _V)(lambda s, d: _overview(dem(s, d), 16))


def _overview(cells, most):
    rows = cells.agg(F.max("r")).first()[0] + 1
    return ops.overview(cells, "z", rows, 40, most)


_MED = "list_sort(list(raw) FILTER (raw IS NOT NULL))[CAST(floor(count(raw) / 2) AS INT) + 1]"
_SURFACE = f"__z AS (SELECT * FROM surface_grid), {_near(3, 'mirror', _NONE)}, __m AS (SELECT r, c, CASE WHEN count(raw) > 0 THEN {_MED} END AS z FROM __n GROUP BY r, c), __k AS (SELECT CAST(max(r) + 1 AS DOUBLE) AS h FROM __m), __g AS (SELECT CAST(floor(r * least(16, h) / h) AS BIGINT) AS r2, CAST(floor(c * 16 / 40.0) AS BIGINT) AS c2, avg(z) AS z FROM __m, __k GROUP BY 1, 2)"


@query("overview_surface", f"{_SURFACE} SELECT r2 AS r, c2 AS c, round_even(coalesce(z, min(z) OVER ()), 1) AS z FROM __g", ("surface_grid",))
def overview_surface(spark, sf_dir):
    """Canopy (NIR as surface over red as ground, per ten), spikes removed, decimated."""
    return _overview(ops.median3(view(spark, sf_dir, "surface_grid"), "z").withColumnRenamed("value", "z"), 16)
