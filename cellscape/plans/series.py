"""Queries on cell series (section F, D6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscape.operators import grids
from cellscape.operators import series as ops
from cellscape.plans.fixtures import view
from cellscape.plans.registry import query

_s = lambda s, d: view(s, d, "cell_series").select("cell", "d", "y")
_g = lambda s, d: view(s, d, "cell_series_dense")
_r = lambda *names: (lambda df: df.withColumns({n: F.bround(n, 6) for n in names}))

query("lag_features", "SELECT cell, d, round_even(y, 6) AS y, round_even(lag(y, 1) OVER w, 6) AS lag_1, round_even(lag(y, 3) OVER w, 6) AS lag_3, round_even(lead(y, 2) OVER w, 6) AS lead_2 FROM cell_series_dense WINDOW w AS (PARTITION BY cell ORDER BY d)", "cell_series_dense")(
    lambda s, d: _r("y", "lag_1", "lag_3", "lead_2")(ops.lag_features(_g(s, d), [1, 3, -2]))
)
# In DuckDB: the nearest valid rows before and after by correlated ranks, from a join of gaps with valid rows.
_NEAR = """__n AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY d) AS n FROM cell_series_dense),
__v AS (SELECT * FROM __n WHERE y IS NOT NULL),
__a AS (SELECT g.cell, g.d, g.n, g.y, max(v.n) AS an FROM __n g LEFT JOIN __v v ON v.cell = g.cell AND v.n <= g.n GROUP BY ALL),
__b AS (SELECT g.cell, g.n, min(v.n) AS bn FROM __n g LEFT JOIN __v v ON v.cell = g.cell AND v.n >= g.n GROUP BY ALL),
__f AS (SELECT a.cell, a.d, a.n, a.y, a.an, b.bn, x.y AS ay, x.d AS ad, z.y AS by_, z.d AS bd FROM __a a JOIN __b b USING (cell, n) LEFT JOIN __v x ON x.cell = a.cell AND x.n = a.an LEFT JOIN __v z ON z.cell = a.cell AND z.n = b.bn) """
_FILL = {
    "forward": "CASE WHEN n - an <= 2 THEN ay END",
    "backward": "by_",
    "nearest": "CASE WHEN by_ IS NULL OR d - ad <= bd - d THEN coalesce(ay, by_) ELSE by_ END",
    "linear": "CASE WHEN ay IS NULL THEN by_ WHEN by_ IS NULL THEN ay ELSE ay + (by_ - ay) * CAST(d - ad AS DOUBLE) / nullif(bd - ad, 0) END",
}
for _m, _sql in _FILL.items():
    query(f"fill_{_m}", f"{_NEAR} SELECT cell, d, round_even(coalesce(y, {_sql}), 6) AS y FROM __f", "cell_series_dense")(
        lambda s, d, m=_m: _r("y")(ops.fill_gaps(_g(s, d), m, 2 if m == "forward" else None).select("cell", "d", "y"))
    )
_X = "__x AS (SELECT cell, y, d, date_diff('day', (SELECT min(d) FROM cell_series), d) / 365.2425 AS x FROM cell_series)"
query("ols_trend", f"{_X}, __g AS (SELECT cell, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM __x GROUP BY cell HAVING count(*) >= 3) SELECT cell, n, round_even(slope, 4) AS slope, round_even(intercept, 4) AS intercept, round_even(CASE WHEN syy > 0 THEN sxy / sqrt(sxx * syy) ELSE 0 END, 6) AS r, round_even(sqrt(greatest(0, syy - slope * sxy) / (n - 2) / sxx), 4) AS se FROM __g", "cell_series")(
    lambda s, d: ops.ols_trend(_s(s, d), p_values=False).select("cell", "n", F.bround("slope", 4).alias("slope"), F.bround("intercept", 4).alias("intercept"), F.bround("r", 6).alias("r"), F.bround("se", 4).alias("se"))
)
# In DuckDB: the share of Student's distribution beyond t in closed form, a finite sum of powers of a cosine for whole degrees of freedom.
_T = """__e AS (SELECT cell, n, round_even(slope, 4) AS slope, n - 2 AS f, abs(slope / sqrt(greatest(0, syy - slope * sxy) / (n - 2) / sxx)) AS t FROM (SELECT cell, count(*) AS n, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM __x GROUP BY cell HAVING count(*) >= 3)),
__a AS (SELECT *, atan(t / sqrt(f)) AS q, list_transform(range(0, CASE WHEN f % 2 = 1 THEN (f - 1) // 2 ELSE f // 2 END), lambda k: CASE WHEN f % 2 = 1 THEN list_product([1.0] || list_transform(range(1, k + 1), lambda j: 2.0 * j / (2 * j + 1))) * pow(cos(atan(t / sqrt(f))), 2 * k + 1) ELSE list_product([1.0] || list_transform(range(1, k + 1), lambda j: (2.0 * j - 1) / (2 * j))) * pow(cos(atan(t / sqrt(f))), 2 * k) END) AS terms FROM __e)"""
query("ols_trend_p", f"{_X}, {_T} SELECT cell, n, slope, round_even(CASE WHEN f % 2 = 1 THEN 1 - 2 / pi() * (q + sin(q) * coalesce(list_sum(terms), 0)) ELSE 1 - sin(q) * coalesce(list_sum(terms), 0) END, 8) AS p FROM __a", "cell_series")(lambda s, d: ops.ols_trend(_s(s, d)).select("cell", "n", F.bround("slope", 4).alias("slope"), F.bround("p", 8).alias("p")))
query("trend_per_year", "__x AS (SELECT cell, y, date_diff('day', min(d) OVER (PARTITION BY cell), d) / 365.25 AS x FROM cell_series) SELECT cell, count(*) AS n, round_even(regr_slope(y, x), 4) AS slope FROM __x GROUP BY cell HAVING count(*) >= 3", "cell_series")(lambda s, d: ops.trend_per_year(_s(s, d)).withColumn("slope", F.bround("slope", 4)))
query("anomaly_zscore", "__k AS (SELECT cell, y, row_number() OVER (PARTITION BY cell ORDER BY d DESC) AS k FROM cell_series) SELECT cell, round_even((max(y) FILTER (k = 1) - avg(y) FILTER (k > 1)) / nullif(stddev_pop(y) FILTER (k > 1), 0), 5) AS z FROM __k GROUP BY cell HAVING count(*) >= 3", "cell_series")(
    lambda s, d: ops.anomaly_zscore(_s(s, d)).withColumn("z", F.bround("z", 5))
)
_PAIR = "__p AS (SELECT a.cell, date_diff('day', a.d, b.d) AS dx, b.y - a.y AS dy FROM cell_series a JOIN cell_series b ON a.cell = b.cell AND a.d < b.d)"
# Rises and falls are counted and equal values are ties, so the means must not depend on the order in which rows are added.
_e = lambda s, d: view(s, d, "cell_series_exact")
_EXACT_PAIR = _PAIR.replace("cell_series", "cell_series_exact")
query("mann_kendall", f"{_EXACT_PAIR}, __s AS (SELECT cell, CAST(sum(sign(dy)) AS DOUBLE) AS s, count(*) AS m FROM __p GROUP BY cell), __n AS (SELECT cell, count(*) AS n FROM cell_series_exact GROUP BY cell HAVING count(*) >= 4) SELECT cell, n, s, round_even(s / m, 9) AS tau, round_even(CASE WHEN s > 0 THEN (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) WHEN s < 0 THEN (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) ELSE 0 END, 9) AS z FROM __s JOIN __n USING (cell)", "cell_series_exact")(
    lambda s, d: _r9(ops.mann_kendall(_e(s, d), p_values=False))
)


def _r9(df):
    return df.withColumns({"tau": F.bround("tau", 9), "z": F.bround("z", 9)})


# In DuckDB: both tails of the normal distribution by the error function's series, whose terms follow each other by a factor.
_TAILS = "1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: list_product([abs(z) / sqrt(2)] || list_transform(range(1, k + 1), lambda j: -z * z / 2 / j)) / (2 * k + 1)))"
query("mann_kendall_p", f"{_EXACT_PAIR}, __s AS (SELECT cell, CAST(sum(sign(dy)) AS DOUBLE) AS s FROM __p GROUP BY cell), __n AS (SELECT cell, count(*) AS n FROM cell_series_exact GROUP BY cell HAVING count(*) >= 4), __z AS (SELECT cell, n, s, CASE WHEN s > 0 THEN (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) WHEN s < 0 THEN (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) ELSE 0 END AS z FROM __s JOIN __n USING (cell)), __q AS (SELECT *, {_TAILS} AS p FROM __z) SELECT cell, n, s, round_even(p, 7) AS p, p < 0.05 AS significant FROM __q", "cell_series_exact")(lambda s, d: ops.mann_kendall(_e(s, d)).select("cell", "n", "s", F.bround("p", 7).alias("p"), "significant"))
query("sens_slope", f"{_PAIR} SELECT cell, round_even(median(dy / (dx / 365.2425)), 5) AS slope FROM __p GROUP BY cell HAVING count(*) >= 3", "cell_series")(lambda s, d: ops.sens_slope(_s(s, d)).withColumn("slope", F.bround("slope", 5)))
query("seasonal_baseline", "SELECT cell, d, round_even(y, 6) AS y, round_even(median(y) OVER (PARTITION BY cell, month(d)), 6) AS base, round_even(y - median(y) OVER (PARTITION BY cell, month(d)), 6) AS anomaly FROM cell_series", "cell_series")(lambda s, d: _r("y", "base", "anomaly")(ops.seasonal_baseline(_s(s, d))))
_STEPS = """__g AS (SELECT cell, avg(y) AS m, stddev_pop(y) AS sd, count(*) AS n FROM cell_series WHERE y IS NOT NULL GROUP BY cell),
__z AS (SELECT s.cell, row_number() OVER (PARTITION BY s.cell ORDER BY d) - 1 AS i, (y - m) / sd AS z FROM cell_series s JOIN __g g ON g.cell = s.cell WHERE y IS NOT NULL AND g.n >= 6 AND sd >= 1e-6),
__w AS (SELECT cell, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, false AS hit FROM __g
  UNION ALL SELECT cell, i, up, down, up > 3.0 OR down > 3.0 FROM (SELECT z.cell, z.i, greatest(0.0, CASE WHEN w.hit THEN 0.0 ELSE w.up END + z.z - 0.5) AS up, greatest(0.0, CASE WHEN w.hit THEN 0.0 ELSE w.down END - z.z - 0.5) AS down FROM __w w JOIN __z z ON z.cell = w.cell AND z.i = w.i + 1))"""
query("cusum", f"{_STEPS} SELECT cell, CAST(count(*) FILTER (hit) AS INT) AS changes, CAST(coalesce(min(i) FILTER (hit), -1) AS INT) AS first FROM __w GROUP BY cell", "cell_series", recursive=True)(lambda s, d: ops.cusum(_s(s, d)))
# In DuckDB: similarities of all pairs, costs of all segments, and the best last cut of each end in turn, kept in a list.
_CUTS = """__y AS (SELECT cell, y, row_number() OVER (PARTITION BY cell ORDER BY d) AS i, count(*) OVER (PARTITION BY cell) AS n FROM cell_series WHERE y IS NOT NULL),
__p AS (SELECT a.cell, a.i, b.i AS k, power(a.y - b.y, 2) AS gap FROM __y a JOIN __y b ON a.cell = b.cell AND a.i < b.i),
__m AS (SELECT cell, CASE WHEN median(gap) = 0 THEN 1 ELSE median(gap) END AS mid FROM __p GROUP BY cell),
__k AS (SELECT cell, i, k, exp(-greatest(0.01, least(100.0, gap / mid))) AS alike FROM __p JOIN __m USING (cell)),
__e AS (SELECT cell, n, b, row_number() OVER (PARTITION BY cell ORDER BY b) AS j FROM (SELECT DISTINCT cell, n, unnest(list_filter(range(0, n, 5), lambda x: x >= 3) || [n]) AS b FROM __y WHERE n >= 6)),
__t AS (SELECT cell, n, b, j, unnest(list_filter(range(0, n, 5), lambda x: b - x >= 3)) AS t FROM __e),
__c AS (SELECT cell, n, b, j, list({'t': t, 'c': c} ORDER BY t) AS costs FROM (SELECT __t.cell, n, b, j, t, (b - t) - ((b - t) + 2 * coalesce(sum(alike), 0)) / (b - t) + 3 * ln(n) AS c FROM __t LEFT JOIN __k ON __k.cell = __t.cell AND i > t AND k <= b GROUP BY __t.cell, n, b, j, t) GROUP BY cell, n, b, j),
__w AS (
  SELECT DISTINCT cell, CAST(0 AS BIGINT) AS j, [{'b': CAST(0 AS BIGINT), 'v': CAST(0 AS DOUBLE), 'changes': 0, 'first': CAST(-1 AS BIGINT)}] AS st FROM __e
  UNION ALL
  SELECT cell, j, list_append(st, {'b': b, 'v': best.v, 'changes': CASE WHEN best.t = 0 THEN 0 ELSE best.s.changes + 1 END, 'first': CASE WHEN best.t = 0 THEN -1 WHEN best.s.changes = 0 THEN best.t ELSE best.s.first END})
  FROM (SELECT c.cell, c.j, b, st, list_sort(list_filter(list_transform(costs, lambda x: {'v': list_filter(st, lambda s: s.b = x.t)[1].v + x.c, 't': x.t, 's': list_filter(st, lambda s: s.b = x.t)[1]}), lambda x: x.v IS NOT NULL))[1] AS best FROM __w w JOIN __c c ON c.cell = w.cell AND c.j = w.j + 1)
), __l AS (SELECT cell, st[-1] AS x FROM __w JOIN (SELECT cell, max(j) AS j FROM __e GROUP BY cell) USING (cell, j))"""
query("segment", f"{_CUTS} SELECT cell, CAST(coalesce(x.changes, 0) AS INT) AS changes, CAST(coalesce(x.first, -1) AS INT) AS first FROM (SELECT DISTINCT cell FROM cell_series) LEFT JOIN __l USING (cell)", "cell_series", recursive=True)(lambda s, d: ops.segments(_s(s, d)))
query("segment_binseg")(lambda s, d: ops.segments(_s(s, d), penalty=1.0, method="binseg"))
query("stl")(lambda s, d: ops.stl(_g(s, d), period=7))
_FC = "__x AS (SELECT cell, y, CAST(date_diff('day', (SELECT min(d) FROM cell_series), d) AS DOUBLE) AS x FROM cell_series), __g AS (SELECT cell, count(*) AS n, min(x) AS x0, max(x) AS x1, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m, arg_min(y, x) AS y0, arg_max(y, x) AS y1 FROM __x GROUP BY cell HAVING count(*) >= 2), __s AS (SELECT *, (x1 - x0) / (n - 1) AS gap, CAST(unnest([1, 2, 3]) AS INT) AS step FROM __g)"
for _m, _y in {"linear": "a + b * (x1 + step * gap)", "mean": "m", "drift": "y1 + step * gap * (y1 - y0) / nullif(x1 - x0, 0)"}.items():
    query(f"forecast_{_m}", f"{_FC} SELECT cell, step, (SELECT min(d) FROM cell_series) + CAST(floor(x1 + step * gap) AS INT) AS d, round_even({_y}, 7) AS y FROM __s", "cell_series")(
        lambda s, d, m=_m: ops.forecast(_s(s, d), 3, m).withColumn("y", F.bround("y", 7))
    )
query("cluster_series")(lambda s, d: ops.cluster_series(ops.fill_gaps(_g(s, d)).select("cell", "d", "y")))
# Three dates, not in order, the second date on a grid moved by one column.
query("load_series", "SELECT 0 AS t, DATE '2019-07-01' AS d, r, c, nir AS value FROM scene_cells UNION ALL SELECT 1, DATE '2020-05-01', g.r, g.c, s.red FROM scene_cells g LEFT JOIN scene_cells s ON s.r = g.r AND s.c = g.c - 1 UNION ALL SELECT 2, DATE '2021-06-01', r, c, swir1 FROM scene_cells", "scene_cells")(lambda s, d: _loaded(view(s, d, "scene_cells")))


def _loaded(cells):
    grid = grids.Grid(32631, 500000.0, 5000000.0, 10.0, 10.0, 40, cells.agg(F.max("r")).first()[0] + 1)
    moved = grids.Grid(32631, 500010.0, 5000000.0, 10.0, 10.0, 40, grid.height)
    scenes = [grids.Scene(n, date, g, cells.select("r", "c", F.col(n).alias("value"))) for n, date, g in (("red", "2020-05-01", moved), ("nir", "2019-07-01", grid), ("swir1", "2021-06-01", grid))]
    # The last row of the scene is a part; aligned dates have its whole rectangle.
    return grids.load_series(scenes, method="nearest").join(cells.select("r", "c"), ["r", "c"], "left_semi").select("t", "d", "r", "c", "value")
