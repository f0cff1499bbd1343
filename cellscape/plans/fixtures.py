"""Derived views over the given tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_BAND = "CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE CAST({} AS DOUBLE) END AS {}"
_BANDS = [
    ("1300 + (p_partkey * 31 + p_size * 17) % 900", "blue"),
    ("1400 + (p_partkey * 37 + p_size * 29) % 1100", "green"),
    ("1300 + (p_partkey * 41 + p_size * 53) % 1500", "red"),
    ("1600 + (p_partkey * 43 + p_size * 61) % 1900", "red_edge"),
    ("1500 + (p_partkey * 47 + p_size * 71) % 3500", "nir"),
    ("1500 + (p_partkey * 59 + p_size * 73) % 2900", "swir1"),
    ("1400 + (p_partkey * 67 + p_size * 79) % 2300", "swir2"),
    ("42000 + (p_partkey * 83 + p_size * 89) % 5000", "thermal"),
]
OPTICAL = [b for _, b in _BANDS[:7]]
_GRID = "CAST(floor(p_partkey / 40.0) AS BIGINT) AS r, p_partkey % 40 AS c"

#: Name, the tables and views it reads, SQL.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "scene_cells": (("part",), f"SELECT {_GRID}, {', '.join(_BAND.format(*b) for b in _BANDS)}, CAST((p_partkey + p_size) % 12 AS INT) AS scl, CAST(CASE WHEN p_size % 7 = 0 THEN 1024 WHEN p_size % 11 = 0 THEN 2048 ELSE 0 END AS INT) AS qa60 FROM part"),
    "refl": (("scene_cells",), f"SELECT r, c, {', '.join(f'{b} / 10000.0 AS {b}' for b in OPTICAL)}, thermal, scl, qa60 FROM scene_cells"),
    "dem_cells": (("part",), f"SELECT {_GRID}, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE CAST(p_size * 4 + abs(p_partkey % 40 - 20) * 5 AS DOUBLE) + floor(p_partkey / 40.0) END AS z FROM part"),
    "sar_cells": (("part",), f"SELECT {_GRID}, CAST((p_partkey * 13 + p_size) % 200 AS DOUBLE) / 1000.0 AS vv_before, CAST((p_partkey * 19 + p_size * 3) % 90 AS DOUBLE) / 1000.0 AS vv_after FROM part"),
    "cell_series": (("events",), "SELECT user_id AS cell, CAST(ts AS DATE) AS d, avg(value) AS y, count(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE)"),
    # The same with whole sums of millionths: equal means are equal numbers, in whatever order rows are added.
    "cell_series_exact": (("events",), "SELECT user_id AS cell, CAST(ts AS DATE) AS d, CAST(sum(CAST(round(value * 1000000) AS BIGINT)) AS DOUBLE) / (nullif(count(value), 0) * CAST(1000000 AS DOUBLE)) AS y FROM events GROUP BY user_id, CAST(ts AS DATE)"),
    "dates": (("events",), "SELECT DISTINCT CAST(ts AS DATE) AS d FROM events"),
    "cell_series_dense": (("events", "cell_series"), "SELECT g.cell, g.d, s.y FROM (SELECT u.cell, t.d FROM (SELECT DISTINCT user_id AS cell FROM events) u CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) t) g LEFT JOIN cell_series s ON s.cell = g.cell AND s.d = g.d"),
    "points": (("lineitem",), "SELECT CAST(l_partkey % 100 AS DOUBLE) + l_discount AS x, CAST(l_suppkey % 100 AS DOUBLE) + l_tax AS y, l_quantity AS z, l_linenumber AS cls FROM lineitem"),
    "stac_items": (("orders",), "SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 3 = 0 THEN 'sentinel-2-l2a' WHEN o_orderkey % 3 = 1 THEN 'landsat-c2-l2' ELSE 'sentinel-1-rtc' END AS collection, o_orderdate AS dt, CAST(o_custkey % 90 AS DOUBLE) / 10.0 AS west, CAST(o_custkey % 70 AS DOUBLE) / 10.0 AS south, CAST(o_custkey % 90 AS DOUBLE) / 10.0 + 1.1 AS east, CAST(o_custkey % 70 AS DOUBLE) / 10.0 + 1.1 AS north, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) END AS cloud, CAST(o_orderkey % 41 AS DOUBLE) AS nodata_pct FROM orders"),
    "zones": (("region",), "SELECT r_regionkey AS zone_id, r_name AS zone_name, CAST(r_regionkey * 8 AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(r_regionkey * 8 + 7.5 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS y1, CAST(r_regionkey * 8 + 3.5 AS DOUBLE) AS x2, CAST(40.25 AS DOUBLE) AS y2 FROM region"),
    "class_pairs": (("events",), "SELECT user_id AS cell, CAST(min(event_id) % 4 + 1 AS INT) AS from_class, CAST(max(event_id) % 4 + 1 AS INT) AS to_class FROM events GROUP BY user_id"),
    "predictions": (("embeddings",), "SELECT vec_id, CAST(label AS INT) AS y_true, CAST(CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 WHEN vec_id % 37 = 0 THEN -1 ELSE label END AS INT) AS y_pred FROM embeddings"),
    "tile_verdicts": (("events",), "SELECT user_id AS image_id, event_id AS tile_id, CASE event_type WHEN 'view' THEN 'correct' WHEN 'click' THEN 'correct' WHEN 'purchase' THEN 'correct' WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'unsure' ELSE 'correct' END ELSE CASE WHEN user_id % 3 = 0 THEN 'wrong' ELSE NULL END END AS verdict FROM events"),
    "spectra": (("embeddings",), "SELECT vec_id, label, transform(embedding, x -> CAST(x AS DOUBLE) + 0.6) AS spectrum FROM embeddings"),
    "rasters": (("supplier",), "SELECT s_suppkey AS raster_id, CAST(40 + s_suppkey % 3 AS INT) AS width, CAST(50 AS INT) AS height, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 4326 ELSE 3857 END AS INT) AS srid, CASE WHEN s_suppkey % 4 = 0 THEN 0.0001 ELSE 10.0 + s_suppkey % 2 END AS dx, CASE WHEN s_suppkey % 4 = 0 THEN 0.0001 ELSE 10.0 END AS dy, CASE WHEN s_suppkey % 4 = 0 THEN 20.0 + s_suppkey % 50 ELSE 1000000.0 + s_suppkey * 1000 END AS x0, CASE WHEN s_suppkey % 4 = 0 THEN 50.0 - s_suppkey % 90 ELSE 5000000.0 - s_suppkey * 500 END AS y0, CASE s_suppkey % 8 WHEN 0 THEN 'B4' WHEN 1 THEN 'b08' WHEN 2 THEN 'Red' WHEN 3 THEN 'sigma_VV_db' WHEN 4 THEN 'swir16' WHEN 5 THEN 'B05' WHEN 6 THEN 'nir' ELSE 'something' END AS label, CASE s_suppkey % 4 WHEN 0 THEN 'Sentinel-2A MSIL2A' WHEN 1 THEN 'LANDSAT_8' WHEN 2 THEN 's1a iw' ELSE 'unknown craft' END AS platform, CASE s_suppkey % 5 WHEN 0 THEN '2021-3-05' WHEN 1 THEN '05/03/2021' WHEN 2 THEN '13-02-2020' WHEN 3 THEN '02/14/2020T00:00' ELSE '2020-13-40' END AS date_text, CASE s_suppkey % 6 WHEN 0 THEN '665 nm' WHEN 1 THEN '0.842 um' WHEN 2 THEN '1610.4' WHEN 3 THEN '2.2' WHEN 4 THEN 'band 7' ELSE 'none' END AS wavelength_text FROM supplier"),
    "band_catalog": (("embeddings",), "SELECT CAST(i AS BIGINT) AS band, CAST(400 + 32 * i AS BIGINT) AS wl_nm FROM (SELECT explode(sequence(0, n - 1)) AS i FROM (SELECT max(size(embedding)) AS n FROM embeddings))"),
    # Bands of many instruments, one a supplier.
    "instrument_bands": (("supplier",), "SELECT s_suppkey AS band, CAST(400 + s_suppkey * 37 % 2101 AS BIGINT) AS wl_nm FROM supplier"),
    # The scene's whole rectangle: cells beyond its last part row, and missing ones, are 0.1.
    "rgb_cells": (("refl",), "SELECT g.r, g.c, coalesce(s.red, 0.1) AS red, coalesce(s.green, 0.1) AS green, coalesce(s.blue, 0.1) AS blue FROM (SELECT r, explode(sequence(0L, 39L)) AS c FROM (SELECT DISTINCT r FROM refl)) g LEFT JOIN refl s ON s.r = g.r AND s.c = g.c"),
    "dem_grid": (("dem_cells",), "SELECT g.r, g.c, s.z FROM (SELECT r, explode(sequence(0L, 39L)) AS c FROM (SELECT DISTINCT r FROM dem_cells)) g LEFT JOIN dem_cells s ON s.r = g.r AND s.c = g.c"),
    "surface_grid": (("scene_cells",), "SELECT g.r, g.c, CASE WHEN s.nir IS NOT NULL AND s.red IS NOT NULL THEN greatest(0.0, least(500.0, (s.nir - s.red) / 10)) END AS z FROM (SELECT r, explode(sequence(0L, 39L)) AS c FROM (SELECT DISTINCT r FROM scene_cells)) g LEFT JOIN scene_cells s ON s.r = g.r AND s.c = g.c"),
    # Boxes over a wide area: one layer an order, one a customer.
    "footprints": (("orders",), "SELECT id, x AS west, y AS south, x + 0.33 AS east, y + 0.27 AS north FROM (SELECT o_orderkey AS id, CAST((o_orderkey * 37 + o_custkey * 11) % 3500 AS DOUBLE) / 100.0 AS x, CAST((o_orderkey * 17 + o_custkey * 3) % 1700 AS DOUBLE) / 100.0 AS y FROM orders) o"),
    "service_areas": (("customer",), "SELECT id, x AS west, y AS south, x + 0.415 AS east, y + 0.375 AS north FROM (SELECT c_custkey AS id, CAST(c_custkey * 53 % 3500 AS DOUBLE) / 100.0 + 0.003 AS x, CAST(c_custkey * 29 % 1700 AS DOUBLE) / 100.0 + 0.003 AS y FROM customer) c"),
}
#: Where DuckDB says a view otherwise.
IN_DUCKDB = {
    "spectra": "SELECT vec_id, label, [CAST(x AS DOUBLE) + 0.6 FOR x IN embedding] AS spectrum FROM embeddings",
    "band_catalog": "SELECT i AS band, 400 + 32 * i AS wl_nm FROM (SELECT unnest(range(n)) AS i FROM (SELECT max(len(embedding)) AS n FROM embeddings))",
    "surface_grid": VIEWS["surface_grid"][1].replace("explode(sequence(0L, 39L))", "unnest(range(40))"),
    "rgb_cells": VIEWS["rgb_cells"][1].replace("explode(sequence(0L, 39L))", "unnest(range(40))"),
    "dem_grid": VIEWS["dem_grid"][1].replace("explode(sequence(0L, 39L))", "unnest(range(40))"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table, as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    needs, sql = VIEWS[name]
    for n in needs:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in needs}) if needs else spark.sql(sql)


def with_views(*names: str) -> str:
    """`WITH ...` for DuckDB: the named views and those that they read."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in VIEWS[name][0]:
                add(n)
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({IN_DUCKDB.get(n, VIEWS[n][1])})" for n in order) + " "
