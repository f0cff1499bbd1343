"""Queries on cells: scans, indices, calibration, masks (sections A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscape.functions.indices import INDICES, index
from cellscape.functions.sar import to_db
from cellscape.operators import cells as ops
from cellscape.operators import change
from cellscape.operators.grids import Grid, Scene
from cellscape.plans.fixtures import OPTICAL, view
from cellscape.plans.registry import query

#: The role catalog of the fixture scene.
ROLE_ROWS = [(i + 1, b, b) for i, b in enumerate([*OPTICAL, "thermal"])] + [(9, "scl", None), (10, "qa60", None)]
_scene = lambda s, d: view(s, d, "scene_cells")
_refl = lambda s, d: view(s, d, "refl")
_GRID = Grid(32631, 500000.0, 5000000.0, 10.0, 10.0, 40, 50)


def _sar(spark, sf_dir):
    """Backscatter before and after."""
    return [view(spark, sf_dir, "sar_cells").select("r", "c", F.col(f"vv_{k}").alias("value")) for k in ("before", "after")]




def role_catalog(spark):
    return spark.createDataFrame(ROLE_ROWS, "band int, label string, role string")


# In DuckDB: each index over reflectance columns.
_SAVI = "1.5 * (nir - red) / (nir + red + 0.5)"
_nd = lambda a, b: f"({a} - {b}) / nullif({a} + {b}, 0)"
_HALF = f"(({_SAVI} + {_nd('green', 'swir1')}) / 2)"
INDEX_SQL = {
    "ndvi": _nd("nir", "red"),
    "ndre": _nd("nir", "red_edge"),
    "ndci": _nd("red_edge", "red"),
    "msavi2": "0.5 * (2 * nir + 1 - sqrt(greatest(0.0, (2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red))))",
    "savi": _SAVI,
    "evi": "2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0)",
    "ndmi": _nd("nir", "swir1"),
    "nbr": _nd("nir", "swir2"),
    "ndwi": _nd("green", "nir"),
    "mndwi": _nd("green", "swir1"),
    "ndbi": _nd("swir1", "nir"),
    "ibi": f"({_nd('swir1', 'nir')} - {_HALF}) / nullif({_nd('swir1', 'nir')} + {_HALF}, 0)",
    "bsi": "((swir1 + red) - (nir + blue)) / nullif((swir1 + red) + (nir + blue), 0)",
    "ui": _nd("swir2", "nir"),
}


def _index_query(name: str):
    @query(f"idx_{name}", f"SELECT r, c, round_even({INDEX_SQL[name]}, 9) AS value FROM refl", "refl")
    def run(spark, sf_dir):
        return _refl(spark, sf_dir).select("r", "c", F.bround(index(name), 9).alias("value"))


for _name in INDEX_SQL:
    _index_query(_name)
assert set(INDEX_SQL) | {"lst"} <= set(INDICES)

query("nd", f"SELECT r, c, {_nd('nir', 'red')} AS value FROM scene_cells", "scene_cells")(lambda s, d: _scene(s, d).select("r", "c", INDICES["ndvi"].build({"nir": F.col("nir"), "red": F.col("red")}).alias("value")))
query("idx_lst", "SELECT r, c, round_even(CASE WHEN (SELECT quantile_cont(thermal, 0.5) FROM scene_cells) > 1000 THEN thermal * 0.00341802 + 149.0 - 273.15 ELSE thermal END, 9) AS value FROM scene_cells", "scene_cells")(lambda s, d: ops.celsius(_scene(s, d)).select("r", "c", F.bround("thermal", 9).alias("value")))
query("scan_band", "SELECT r, c, nullif(red, 1500) AS value FROM scene_cells", "scene_cells")(lambda s, d: ops.scan_band(_scene(s, d), "red", 1500.0))
query("scan_role", "SELECT r, c, swir1 AS value FROM scene_cells", "scene_cells")(lambda s, d: ops.scan_role(_scene(s, d), role_catalog(s), "swir1"))
query("scan_tiles", "SELECT CAST(floor(r / 16.0) AS BIGINT) AS tile_r, CAST(floor(c / 16.0) AS BIGINT) AS tile_c, count(*) AS n, count(nir) AS valid, round_even(avg(nir), 6) AS mean FROM scene_cells GROUP BY ALL", "scene_cells")(
    lambda s, d: ops.with_tiles(_scene(s, d), 16).groupBy("tile_r", "tile_c").agg(F.count("*").alias("n"), F.count("nir").alias("valid"), F.bround(F.avg("nir"), 6).alias("mean"))
)
query("aoi_window", "SELECT count(*) AS n, count(*) FILTER (nir IS NOT NULL AND nir <> 0) AS valid, round_even(count(*) FILTER (nir IS NOT NULL AND nir <> 0) * 100.0 / count(*), 4) AS valid_pct FROM scene_cells WHERE r >= 1 AND r < 4 AND c >= 5 AND c < 30", "scene_cells")(lambda s, d: ops.aoi_window(_scene(s, d), 1, 4, 5, 30, band="nir"))


@query("map_tiles", "__m AS (SELECT CAST(floor(r / 16.0) AS BIGINT) AS tr, CAST(floor(c / 16.0) AS BIGINT) AS tc, avg(nir) AS m FROM scene_cells GROUP BY 1, 2) SELECT r, c, round_even(nir - m, 6) AS value FROM scene_cells s JOIN __m ON tr = floor(s.r / 16.0) AND tc = floor(s.c / 16.0)", "scene_cells")
def map_tiles(spark, sf_dir):
    def centred(pdf):
        return pdf.assign(value=pdf["nir"] - pdf["nir"].mean())[["r", "c", "value"]]

    return ops.map_tiles(_scene(spark, sf_dir).select("r", "c", "nir"), centred, "r long, c long, value double", 16).withColumn("value", F.bround(F.nanvl("value", F.lit(None).cast("double")), 6))


_P = lambda b, p: f"(SELECT quantile_cont({b}, {p}) FROM scene_cells)"
_CAL = lambda b: f"CASE WHEN {b} IS NULL THEN NULL WHEN {_P(b, 0.99)} <= 2 THEN {b} ELSE greatest(0.0001, least(1.5, ({b} + CASE WHEN {_P(b, 0.01)} > 700 THEN -1000.0 ELSE 0.0 END) / 10000.0)) END"
query("surface_reflectance", f"SELECT r, c, {_CAL('red')} AS red, {_CAL('nir')} AS nir FROM scene_cells", "scene_cells")(lambda s, d: ops.surface_reflectance(_scene(s, d), ["red", "nir"], date="2023-05-01").select("r", "c", "red", "nir"))
query("refl_autoscale", f"SELECT r, c, CASE WHEN {_P('swir1', 0.99)} > 2 THEN CASE WHEN swir1 IS NOT NULL THEN greatest(0.0, least(1.5, swir1 / 10000.0)) END ELSE swir1 END AS value FROM scene_cells", "scene_cells")(lambda s, d: ops.autoscaled(_scene(s, d), "swir1").select("r", "c", F.col("swir1").alias("value")))
query("compute_index", f"__c AS (SELECT r, c, {_CAL('red')} AS red, {_CAL('nir')} AS nir FROM scene_cells) SELECT r, c, round_even((nir - red) / nullif(nir + red, 0), 9) AS value FROM __c", "scene_cells")(
    lambda s, d: ops.compute_index(_scene(s, d), "ndvi", role_catalog(s), date="2023-05-01").withColumn("value", F.bround("value", 9))
)
query("to_db", "SELECT r, c, round_even(CASE WHEN vv_before > 0 THEN 10 * log10(vv_before) END, 9) AS value FROM sar_cells", "sar_cells")(lambda s, d: view(s, d, "sar_cells").select("r", "c", F.bround(to_db(F.col("vv_before")), 9).alias("value")))
_DB = lambda c: f"CASE WHEN {c} > 0 THEN 10 * log10({c}) END"
query("db_change", f"SELECT r, c, round_even({_DB('vv_after')} - {_DB('vv_before')}, 9) AS value FROM sar_cells", "sar_cells")(
    lambda s, d: change.db_change(*_sar(s, d)).select("r", "c", F.bround("diff", 9).alias("value"))
)
query("backscatter_db", f"SELECT r, c, round_even({_DB('vv_before')}, 9) AS value FROM sar_cells", "sar_cells")(lambda s, d: ops.backscatter_db(view(s, d, "sar_cells"), "vv_before").select("r", "c", F.bround("vv_before", 9).alias("value")))
query("flood", f"SELECT r, c FROM sar_cells WHERE {_DB('vv_before')} - {_DB('vv_after')} >= 3.0 AND {_DB('vv_after')} <= -15.0", "sar_cells")(
    lambda s, d: change.flood_candidates(*[x.withColumn("value", to_db(F.col("value"))) for x in _sar(s, d)])
)
query("change_magnitude", "SELECT r, c, swir2 - swir1 AS value FROM scene_cells", "scene_cells")(
    lambda s, d: change.difference(_scene(s, d).select("r", "c", F.col("swir1").alias("value")), _scene(s, d).select("r", "c", F.col("swir2").alias("value"))).select("r", "c", F.col("diff").alias("value"))
)
query("valid_mask", "SELECT r, c FROM scene_cells WHERE red IS NOT NULL AND nir IS NOT NULL", "scene_cells")(lambda s, d: _scene(s, d).dropna(subset=["red", "nir"]).select("r", "c"))
query("select_extreme", "__q AS (SELECT quantile_cont(nir, 0.8) AS cutoff FROM scene_cells) SELECT r, c, nir, cutoff FROM scene_cells, __q WHERE nir >= cutoff", "scene_cells")(lambda s, d: ops.select_extreme(_scene(s, d), "nir", 0.2, "high").select("r", "c", "nir", "cutoff"))
query("threshold_mask", "SELECT r, c FROM scene_cells WHERE nir > 3000", "scene_cells")(lambda s, d: _scene(s, d).filter("nir > 3000").select("r", "c"))


def _masks(spark, sf_dir):
    cells = _scene(spark, sf_dir)
    return [cells.filter("nir > 3000"), cells.filter("red < 2200")]


query("mask_and", "SELECT r, c FROM scene_cells WHERE nir > 3000 AND red < 2200", "scene_cells")(lambda s, d: ops.combine_masks(_masks(s, d), "and"))
query("mask_or", "SELECT r, c FROM scene_cells WHERE nir > 3000 OR red < 2200", "scene_cells")(lambda s, d: ops.combine_masks(_masks(s, d), "or"))
query("mask_and_not", "SELECT r, c FROM scene_cells WHERE nir > 3000 AND NOT red < 2200", "scene_cells")(lambda s, d: ops.combine_masks(_masks(s, d), "and_not"))
query("significant_change", "__x AS (SELECT r, c, swir2 - swir1 AS value FROM scene_cells), __s AS (SELECT stddev_pop(value) AS cutoff FROM __x) SELECT r, c, value, round_even(cutoff, 6) AS cutoff FROM __x, __s WHERE value <= -cutoff", "scene_cells")(
    lambda s, d: ops.significant_change(_scene(s, d).select("r", "c", (F.col("swir2") - F.col("swir1")).alias("value"))).withColumn("cutoff", F.bround("cutoff", 6))
)
query("cloud_scl", "SELECT count(*) AS n, count(*) FILTER (scl IN (3, 8, 9, 10)) AS cloud, round_even(CAST(count(*) FILTER (scl IN (3, 8, 9, 10)) AS DOUBLE) / count(*), 4) AS fraction FROM scene_cells WHERE scl <> 0", "scene_cells")(lambda s, d: ops.cloud_fraction(_scene(s, d), "scl"))
query("cloud_qa", "SELECT count(*) AS n, count(*) FILTER (qa60 & 3072 <> 0) AS cloud, round_even(CAST(count(*) FILTER (qa60 & 3072 <> 0) AS DOUBLE) / count(*), 4) AS fraction FROM scene_cells", "scene_cells")(lambda s, d: ops.cloud_fraction(_scene(s, d), "qa"))
query("cloud_spectral", "__f AS (SELECT (blue * 2.5 + red * 2.5) / 2 / 10000.0 > 0.35 AND swir1 / 10000.0 > 0.20 AS f FROM scene_cells) SELECT count(*) AS n, count(*) FILTER (f) AS cloud, round_even(CAST(count(*) FILTER (f) AS DOUBLE) / count(*), 4) AS fraction FROM __f", "scene_cells")(
    lambda s, d: ops.cloud_fraction(_scene(s, d).withColumns({"blue": F.col("blue") * 2.5, "red": F.col("red") * 2.5}), "spectral")
)
query("terrestrial_mask", f"SELECT r, c FROM refl WHERE scl NOT IN (0, 1, 3, 6, 8, 9, 10, 11) AND NOT coalesce({_nd('green', 'swir1')} > 0, false) AND NOT coalesce({_nd('green', 'nir')} > 0.1, false)", "refl")(lambda s, d: change.terrestrial(_refl(s, d)).select("r", "c"))
query("stretch", f"SELECT r, c, CAST(floor(greatest(0.0, least(1.0, (nir - {_P('nir', 0.02)}) / nullif({_P('nir', 0.98)} - {_P('nir', 0.02)}, 0))) * 255) AS INT) AS value FROM (SELECT * FROM scene_cells WHERE nir IS NOT NULL)", "scene_cells")(
    lambda s, d: ops.stretch(_scene(s, d).select("r", "c", "nir"), "nir").filter("nir is not null").select("r", "c", F.col("nir").alias("value"))
)
query("rule_landcover", f"SELECT r, c, CASE WHEN {_nd('green', 'swir1')} > 0.1 THEN 4 WHEN {INDEX_SQL['msavi2']} > 0.2 AND {_nd('nir', 'swir1')} > 0 THEN 1 WHEN {_nd('swir2', 'nir')} > 0 THEN 2 WHEN {INDEX_SQL['bsi']} > 0 THEN 3 ELSE 0 END AS cls FROM refl", "refl")(lambda s, d: change.rule_landcover(_refl(s, d)))
query("index_difference", f"SELECT r, c, round_even({_nd('nir', 'red')}, 9) AS before, round_even({_nd('nir', 'red_edge')}, 9) AS after, round_even({_nd('nir', 'red_edge')} - {_nd('nir', 'red')}, 9) AS diff FROM refl", "refl")(
    lambda s, d: change.index_difference(Scene("a", "2020-05-01", _GRID, _refl(s, d)), Scene("b", "2021-05-01", _GRID, _refl(s, d).withColumn("red", F.col("red_edge")))).select("r", "c", *[F.bround(n, 9).alias(n) for n in ("before", "after", "diff")])
)
query("index_stack", f"SELECT t, r, c, round_even((n - d) / nullif(n + d, 0), 9) AS value FROM (SELECT 0 AS t, r, c, nir AS n, red AS d FROM refl UNION ALL SELECT 1, r, c, nir, red_edge FROM refl UNION ALL SELECT 2, r, c, swir1, red FROM refl)", "refl")(
    lambda s, d: change.index_stack([_refl(s, d).select("r", "c", F.col(n).alias("nir"), F.col(m).alias("red")) for n, m in (("nir", "red"), ("nir", "red_edge"), ("swir1", "red"))]).withColumn("value", F.bround("value", 9))
)
query("mutual_valid", "__v AS (SELECT r, c, red IS NOT NULL AND scl NOT IN (3, 8, 9, 10) AND nir IS NOT NULL AND qa60 & 3072 = 0 AS ok FROM scene_cells) SELECT count(*) AS n, count(*) FILTER (ok) AS valid, round_even(CAST(count(*) FILTER (ok) AS DOUBLE) / count(*), 4) AS fraction, CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) >= 0.15 AS sufficient FROM __v", "scene_cells")(lambda s, d: change.mutual_valid([(_scene(s, d), "red", "scl"), (_scene(s, d), "nir", "qa")]))
query("stack_bands", "SELECT r, c, [red, nir, swir1] AS features FROM refl WHERE red IS NOT NULL AND nir IS NOT NULL AND swir1 IS NOT NULL", "refl")(lambda s, d: change.stack_bands([(_refl(s, d), b) for b in ("red", "nir", "swir1")]))