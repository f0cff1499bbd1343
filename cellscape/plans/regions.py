"""Queries on regions and flow (section H, E10, F14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscape.operators import inspection
from cellscape.operators import regions as ops
from cellscape.plans.fixtures import view
from cellscape.plans.focal import _DEM, dem
from cellscape.plans.registry import ORACLES, query

_mask = lambda s, d: view(s, d, "scene_cells").filter("nir > 2800").select("r", "c")
_labels = lambda s, d: ops.label_regions(_mask(s, d))
# In DuckDB: the smallest cell number reachable over 4-neighbours.
_REACH = """__m AS (SELECT r, c, r * 40 + c AS id FROM scene_cells WHERE nir > 2800), __e AS (SELECT a.id AS a, b.id AS b FROM __m a JOIN __m b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
__t AS (SELECT id AS a, id AS l FROM __m UNION SELECT e.b, t.l FROM __t t JOIN __e e ON e.a = t.a WHERE t.l < e.b), __l AS (SELECT a AS id, min(l) AS l FROM __t GROUP BY a), __n AS (SELECT id, CAST(dense_rank() OVER (ORDER BY l) AS INT) AS label FROM __l), __s AS (SELECT label, count(*) AS size FROM __n GROUP BY label) """


query("label_regions", _REACH + "SELECT id // 40 AS r, id % 40 AS c, label FROM __n", "scene_cells", recursive=True)(_labels)
query("filter_small", _REACH + "SELECT id // 40 AS r, id % 40 AS c, label FROM __n WHERE label IN (SELECT label FROM __s WHERE size >= 4)", "scene_cells", recursive=True)(lambda s, d: ops.filter_small(_labels(s, d), 4))
query("region_summary", _REACH + "SELECT count(*) AS regions, max(size) AS largest, (SELECT list(size ORDER BY size DESC) FROM (SELECT size FROM __s ORDER BY size DESC, label LIMIT 5)) AS sizes FROM __s", "scene_cells", recursive=True)(lambda s, d: ops.region_summary(_labels(s, d)))
query("polygonize")(lambda s, d: ops.polygonize(_labels(s, d), 100.0))
query("distance_to_mask", f"{_DEM}, __m AS (SELECT r, c FROM scene_cells WHERE nir > 4500) SELECT z.r, z.c, round_even(sqrt(min((z.r - m.r) * (z.r - m.r) * 100.0 + (z.c - m.c) * (z.c - m.c) * 64.0)), 6) AS value FROM __z z, __m m GROUP BY z.r, z.c", ("dem_grid", "scene_cells"))(
    lambda s, d: ops.distance_to_mask(dem(s, d), view(s, d, "scene_cells").filter("nir > 4500"), 8.0, 10.0).withColumn("value", F.bround("value", 6))
)
# In DuckDB: levels spread from the outlets, each cell at the higher of its own and the level that came; the lowest that reaches a cell is its own.
_SPREAD = """__c AS (SELECT r, c, z FROM dem_grid WHERE z IS NOT NULL), __d AS (SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS a, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS b),
__o AS (SELECT c.r, c.c, c.z FROM __c c CROSS JOIN __d JOIN __c n ON n.r = c.r + a AND n.c = c.c + b GROUP BY c.r, c.c, c.z HAVING count(*) < 8),
__w AS (SELECT r, c, z AS w FROM __o UNION SELECT n.r, n.c, greatest(w.w, n.z) FROM __w w CROSS JOIN __d JOIN __c n ON n.r = w.r + a AND n.c = w.c + b)"""
query("fill_depressions", f"{_SPREAD} SELECT c.r, c.c, c.z, min(w.w) AS w FROM __c c LEFT JOIN __w w ON w.r = c.r AND w.c = c.c GROUP BY c.r, c.c, c.z", "dem_grid", recursive=True)(lambda s, d: ops.fill_depressions(dem(s, d)).select("r", "c", "z", "w"))
query("flow_direction")(lambda s, d: ops.flow_direction(ops.fill_depressions(dem(s, d)), 10.0, 10.0))
query("flow_accumulation")(lambda s, d: ops.flow_accumulation(ops.flow_direction(ops.fill_depressions(dem(s, d)), 10.0, 10.0)))
# The elevations as they are, pits and all: a cell without a lower neighbour ends its way.  In DuckDB: every cell walks down, and a cell's count is how many walks
# come by.
_DOWN = """__n AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i, unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS a, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS b, unnest([sqrt(200), 10.0, sqrt(200), 10.0, 10.0, sqrt(200), 10.0, sqrt(200)]) AS far),
__c AS (SELECT r, c, z FROM dem_grid WHERE z IS NOT NULL), __f AS (SELECT r, c, nr, nc FROM (SELECT x.r, x.c, y.r AS nr, y.c AS nc, row_number() OVER (PARTITION BY x.r, x.c ORDER BY (x.z - y.z) / far DESC, i) AS k FROM __c x CROSS JOIN __n JOIN __c y ON y.r = x.r + a AND y.c = x.c + b WHERE x.z > y.z) WHERE k = 1)"""
_bare = lambda s, d: ops.flow_direction(dem(s, d).filter("z is not null").select("r", "c", F.col("z").alias("w"), F.lit(-1).alias("back")), 10.0, 10.0)
query("flow_direction_plain", f"{_DOWN} SELECT c.r, c.c, z AS w, nr AS to_r, nc AS to_c FROM __c c LEFT JOIN __f f ON f.r = c.r AND f.c = c.c", "dem_grid")(_bare)
query("flow_accumulation_plain", f"{_DOWN}, __w AS (SELECT r, c FROM __c UNION ALL SELECT nr, nc FROM __w w JOIN __f f ON f.r = w.r AND f.c = w.c) SELECT r, c, count(*) AS acc FROM __w GROUP BY r, c", "dem_grid", recursive=True)(lambda s, d: ops.flow_accumulation(_bare(s, d), 16))
# Each region's sides towards anything else, and its area; outlines have as many corners as sides, and enclose the cells.
query("polygonize_sums", _REACH + ", __d AS (SELECT unnest([-1, 1, 0, 0]) AS a, unnest([0, 0, -1, 1]) AS b), __o AS (SELECT n.label, count(*) AS sides FROM __n n CROSS JOIN __d LEFT JOIN __n m ON m.id // 40 = n.id // 40 + a AND m.id % 40 = n.id % 40 + b AND m.label = n.label WHERE m.id IS NULL GROUP BY n.label) SELECT label, round_even(size * 100.0 / 10000, 3) AS area_ha, CAST(sides AS INT) AS sides, CAST(size AS DOUBLE) AS enclosed FROM __s JOIN __o USING (label)", "scene_cells", recursive=True)(lambda s, d: _outlines(s, d))


def _outlines(spark, sf_dir):
    ring = "rings, q -> aggregate(sequence(0, size(q) - 1), 0D, (s, i) -> s + q[i][0] * q[(i + 1) % size(q)][1] - q[(i + 1) % size(q)][0] * q[i][1]) / 2"
    return ops.polygonize(_labels(spark, sf_dir), 100.0).selectExpr("label", "area_ha", "aggregate(rings, 0, (n, q) -> n + size(q)) AS sides", f"abs(aggregate(transform({ring}), 0D, (s, x) -> s + x)) AS enclosed")


query("wetness_index")(lambda s, d: ops.wetness_index(dem(s, d), 10.0, 10.0))
query("elevation_profile", f"{_DEM}, __p AS (SELECT k, 1.0 + k / 49.0 * 2.5 AS y, 2.0 + k / 49.0 * 30.0 AS x FROM (SELECT CAST(unnest(range(50)) AS DOUBLE) AS k)), __w AS (SELECT k, sum((1 - abs(y - r)) * (1 - abs(x - c)) * z) / nullif(sum((1 - abs(y - r)) * (1 - abs(x - c))), 0) AS z FROM __p JOIN __z ON abs(y - r) < 1 AND abs(x - c) < 1 WHERE z IS NOT NULL GROUP BY k) SELECT CAST(p.k AS BIGINT) AS k, round_even(k / 49.0 * sqrt(2.5 * 2.5 + 30.0 * 30.0) * 10, 6) AS distance, round_even(z, 6) AS z FROM __p p LEFT JOIN __w USING (k)", "dem_grid")(
    lambda s, d: ops.elevation_profile(dem(s, d), "z", (1.0, 2.0), (3.5, 32.0), 10.0, 50).select("k", F.bround("distance", 6).alias("distance"), F.bround("z", 6).alias("z"))
)
_PROFILE = ORACLES["elevation_profile"]
query("profile_summary", f"SELECT round_even(max(distance), 2) AS distance_m, round_even(min(z), 2) AS min_m, round_even(max(z), 2) AS max_m, round_even(coalesce(sum(dz) FILTER (dz > 0), 0), 2) AS gain_m, round_even(coalesce(-sum(dz) FILTER (dz < 0), 0), 2) AS loss_m, round_even(max(degrees(atan(abs(dz) / dx))), 2) AS max_slope, round_even(avg(degrees(atan(abs(dz) / dx))), 2) AS avg_slope FROM (SELECT *, z - lag(z) OVER (ORDER BY k) AS dz, distance - lag(distance) OVER (ORDER BY k) AS dx FROM ({_PROFILE}))")(
    lambda s, d: inspection.profile_summary(ops.elevation_profile(dem(s, d), "z", (1.0, 2.0), (3.5, 32.0), 10.0, 50).withColumns({"distance": F.bround("distance", 6), "z": F.bround("z", 6)}))
)
