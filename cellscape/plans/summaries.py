"""Queries on statistics, classes and verdicts (section E, J2, J3, J8, J9, B24, B25, B44, B45)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cellscape.operators import cells, learning
from cellscape.operators import summaries as ops
from cellscape.operators.quantiles import quantiles
from cellscape.plans.fixtures import table, view
from cellscape.plans.registry import query

_scene = lambda s, d: view(s, d, "scene_cells")
_pred = lambda s, d: view(s, d, "predictions")
_tiles = lambda s, d: view(s, d, "tile_verdicts")

query("raster_stats", "SELECT count(nir) AS valid, count(*) - count(nir) AS nodata, min(nir) AS min, max(nir) AS max, round_even(avg(nir), 6) AS mean, round_even(stddev_pop(nir), 6) AS std, quantile_cont(nir, 0.05) AS p5, quantile_cont(nir, 0.25) AS p25, quantile_cont(nir, 0.5) AS p50, quantile_cont(nir, 0.75) AS p75, quantile_cont(nir, 0.95) AS p95 FROM scene_cells", "scene_cells")(lambda s, d: ops.raster_stats(_scene(s, d), "nir"))
query("percentiles", "SELECT CAST(floor(r / 8.0) AS BIGINT) AS block, round_even(quantile_cont(nir, 0.02), 6) AS p2, round_even(quantile_cont(nir, 0.5), 6) AS p50, round_even(quantile_cont(nir, 0.98), 6) AS p98 FROM scene_cells WHERE nir IS NOT NULL GROUP BY 1", "scene_cells")(
    lambda s, d: quantiles(_scene(s, d).withColumn("block", F.floor(F.col("r") / 8.0)), {"p": ("nir", (0.02, 0.5, 0.98))}, ["block"]).select("block", *[F.bround(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p2", "p50", "p98"))])
)
query("area_stats", "SELECT count(*) FILTER (nir > 3000) AS selected, count(nir) AS valid, round_even(count(*) FILTER (nir > 3000) * 100.0 / count(nir), 4) AS percent, round_even(count(*) FILTER (nir > 3000) * 100.0 / 10000, 3) AS hectares FROM scene_cells", "scene_cells")(lambda s, d: ops.area_stats(_scene(s, d), F.col("nir") > 3000, F.col("nir").isNotNull(), 100.0))
_Q = lambda n, w: f"round_even(count(*) FILTER (nir > 3000 AND (r < h) = {n} AND (c < w) = {w}) * 100.0 / count(*) FILTER (nir > 3000), 2)"
query("quadrants", f"__s AS (SELECT *, floor((max(r) OVER () + 1) / 2) AS h, floor((max(c) OVER () + 1) / 2) AS w FROM scene_cells) SELECT {_Q('true', 'true')} AS north_west, {_Q('true', 'false')} AS north_east, {_Q('false', 'true')} AS south_west, {_Q('false', 'false')} AS south_east FROM __s", "scene_cells")(lambda s, d: ops.quadrants(_scene(s, d), F.col("nir") > 3000))
_GRID = "__b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points), __g AS (SELECT CAST(least(greatest(1, ceil((y1 - y0) / 5.0)) - 1, greatest(0, floor((y1 - y) / 5.0))) AS BIGINT) AS r, CAST(least(greatest(1, ceil((x1 - x0) / 5.0)) - 1, greatest(0, floor((x - x0) / 5.0))) AS BIGINT) AS c, max(z) AS dsm, min(z) AS dtm FROM points, __b GROUP BY 1, 2)"
_grid = lambda s, d: ops.points_to_grid(view(s, d, "points"), 5.0)
_chm = lambda s, d: _grid(s, d).select("r", "c", ops.canopy_height(F.col("dsm"), F.col("dtm") + 20).alias("h"))
_H = "greatest(0.0, least(120.0, dsm - (dtm + 20)))"
query("dsm_dtm", f"{_GRID} SELECT r, c, dsm, dtm FROM __g", "points")(_grid)
query("chm", f"{_GRID} SELECT r, c, {_H} AS h FROM __g", "points")(_chm)
query("canopy_layers", f"{_GRID} SELECT r, c, CASE WHEN {_H} < 0.5 THEN 0 WHEN {_H} < 2 THEN 1 WHEN {_H} < 5 THEN 2 WHEN {_H} < 15 THEN 3 ELSE 4 END AS layer FROM __g", "points")(lambda s, d: _chm(s, d).select("r", "c", ops.canopy_layer(F.col("h")).alias("layer")))
query("canopy_metrics", f"{_GRID}, __h AS (SELECT {_H} AS h, CASE WHEN {_H} >= 1 THEN {_H} END AS t FROM __g) SELECT round_even(count(h) * 25.0, 2) AS total_m2, round_even(count(t) * 25.0, 2) AS canopy_m2, round_even(count(t) * 100.0 / count(h), 2) AS cover, coalesce(round_even(avg(t), 2), 0) AS mean, coalesce(round_even(max(t), 2), 0) AS max, coalesce(round_even(quantile_cont(t, 0.5), 2), 0) AS p50, coalesce(round_even(quantile_cont(t, 0.95), 2), 0) AS p95, coalesce(round_even(stddev_pop(t), 2), 0) AS std, coalesce(round_even(sum(t) * 25.0, 2), 0) AS volume FROM __h", "points")(lambda s, d: ops.canopy_metrics(_chm(s, d), "h", 25.0))
query("otsu", "__p AS (SELECT quantile_cont(nir, 0.005) AS lo, quantile_cont(nir, 0.995) AS hi FROM scene_cells), __h AS (SELECT least(127, CAST(floor((nir - lo) / (hi - lo) * 128) AS BIGINT)) AS bin, lo, hi, count(*) AS n FROM scene_cells, __p WHERE nir >= lo AND nir <= hi GROUP BY 1, 2, 3), __c AS (SELECT bin, n, lo + (bin + 0.5) * (hi - lo) / 128 AS x FROM __h), __w AS (SELECT bin, x, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS w, sum(n * x) OVER (ORDER BY bin) / sum(n) OVER () AS m, sum(n * x) OVER () / sum(n) OVER () AS mt FROM __c) SELECT round_even(x, 6) AS threshold FROM __w ORDER BY CASE WHEN w * (1 - w) > 1e-12 THEN round_even((mt * w - m) * (mt * w - m) / (w * (1 - w)), 9) ELSE 0 END DESC, bin LIMIT 1", "scene_cells")(lambda s, d: ops.otsu(_scene(s, d), "nir").withColumn("threshold", F.bround("threshold", 6)))
# In DuckDB: histogram, Otsu's threshold, the two classes' distance, and peaks of the smoothed histogram, for each k.
_KERNEL = [math.exp(-0.5 * (i / 2.0) ** 2) for i in range(-8, 9)]
_BIMODAL = f"""__p AS (SELECT k, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM __x WHERE v IS NOT NULL GROUP BY k),
__f AS (SELECT x.k, least(127, CAST(floor((v - lo) / (hi - lo) * 128) AS BIGINT)) AS bin, lo, hi, count(*) AS n FROM __x x JOIN __p p ON p.k = x.k WHERE hi > lo AND v >= lo AND v <= hi GROUP BY ALL),
__s AS (SELECT k, bin, n, lo + (bin + 0.5) * (hi - lo) / 128 AS x FROM __f),
__w AS (SELECT k, bin, x, sum(n) OVER (PARTITION BY k ORDER BY bin) / sum(n) OVER (PARTITION BY k) AS w, sum(n * x) OVER (PARTITION BY k ORDER BY bin) / sum(n) OVER (PARTITION BY k) AS m, sum(n * x) OVER (PARTITION BY k) / sum(n) OVER (PARTITION BY k) AS mt FROM __s),
__t AS (SELECT k, x AS threshold FROM __w QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN w * (1 - w) > 1e-12 THEN round_even((mt * w - m) * (mt * w - m) / (w * (1 - w)), 9) ELSE 0 END DESC, bin) = 1),
__d AS (SELECT x.k, threshold, count(v) AS valid, coalesce(sqrt(2.0) * abs(avg(v) FILTER (v <= threshold) - avg(v) FILTER (v > threshold)) / nullif(sqrt(power(stddev_pop(v) FILTER (v <= threshold), 2) + power(stddev_pop(v) FILTER (v > threshold), 2)), 0), 0.0) AS d FROM __x x JOIN __t t ON t.k = x.k GROUP BY x.k, threshold),
__b AS (SELECT t.k, i, coalesce(f.n, 0) AS n FROM (SELECT k, unnest(range(128)) AS i FROM __t) t LEFT JOIN __f f ON f.k = t.k AND f.bin = t.i),
__o AS (SELECT unnest(range(-8, 9)) AS o, unnest({[w / sum(_KERNEL) for w in _KERNEL]}) AS wt),
__y AS (SELECT b.k, b.i, sum(n.n * wt) AS h FROM __b b CROSS JOIN __o JOIN __b n ON n.k = b.k AND n.i = CASE WHEN b.i + o < 0 THEN -1 - (b.i + o) WHEN b.i + o > 127 THEN 255 - (b.i + o) ELSE b.i + o END GROUP BY b.k, b.i),
__a AS (SELECT *, lag(h) OVER (PARTITION BY k ORDER BY i) AS before, lead(h) OVER (PARTITION BY k ORDER BY i) AS after, max(h) OVER (PARTITION BY k) AS top FROM __y),
__e AS (SELECT a.k, a.i, a.h, a.top, coalesce(max(y.i) FILTER (y.i < a.i AND y.h > a.h), 0) AS l, coalesce(min(y.i) FILTER (y.i > a.i AND y.h > a.h), 127) AS r FROM __a a JOIN __y y ON y.k = a.k WHERE a.h > a.before AND a.h >= a.after GROUP BY ALL),
__q AS (SELECT e.k, e.i, e.h - greatest(min(y.h) FILTER (y.i <= e.i), min(y.h) FILTER (y.i >= e.i)) >= 0.03 * e.top AS peak FROM __e e JOIN __y y ON y.k = e.k AND y.i BETWEEN e.l AND e.r GROUP BY e.k, e.i, e.h, e.top),
__m AS (SELECT d.k, threshold, valid, d, CAST(coalesce((SELECT count(*) FROM __q q WHERE q.k = d.k AND q.peak), 0) AS INT) AS peaks FROM __d d)"""
_IS = "valid >= 100 AND (d >= 4.0 OR (peaks >= 2 AND d >= 3.8))"
query("bimodality", f"__x AS (SELECT 1 AS k, nir AS v FROM scene_cells), {_BIMODAL} SELECT valid, round_even(threshold, 6) AS threshold, round_even(d, 3) AS d, peaks, {_IS} AS bimodal FROM __m", "scene_cells")(lambda s, d: ops.bimodality(_scene(s, d), "nir").withColumn("threshold", F.bround("threshold", 6)))
query("adaptive_threshold", f"__x AS (SELECT r, c, CAST(floor(r / 20.0) AS BIGINT) * 1000 + CAST(floor(c / 20.0) AS BIGINT) AS k, CASE WHEN nir > 3000 THEN nir + 9000 ELSE nir END AS v FROM scene_cells), {_BIMODAL} SELECT r, c, CASE WHEN v IS NOT NULL THEN CAST(coalesce({_IS} AND v >= threshold, false) AS INT) END AS value FROM __x LEFT JOIN __m USING (k)", "scene_cells")(
    lambda s, d: ops.adaptive_threshold(_scene(s, d).select("r", "c", F.when(F.col("nir") > 3000, F.col("nir") + 9000).otherwise(F.col("nir")).alias("nir")), "nir", 20)
)
query("tile_stats", "__t AS (SELECT CAST(floor(r / 10.0) AS BIGINT) AS tile_r, CAST(floor(c / 10.0) AS BIGINT) AS tile_c, CAST(scl AS DOUBLE) AS v FROM scene_cells), __n AS (SELECT tile_r, tile_c, CAST(v AS BIGINT) AS cls, count(*) AS n FROM __t GROUP BY ALL), __k AS (SELECT *, row_number() OVER (PARTITION BY tile_r, tile_c ORDER BY (cls = 0), n DESC, cls) AS k, count(*) OVER (PARTITION BY tile_r, tile_c) AS classes FROM __n) SELECT t.tile_r, t.tile_c, count(*) AS total, count(v) AS valid, min(v) AS min, max(v) AS max, round_even(avg(v), 6) AS mean, round_even(stddev_pop(v), 6) AS std, any_value(k.classes) AS classes, any_value(k.cls) AS dominant, round_even(any_value(k.n) * 100.0 / count(v), 2) AS dominant_pct FROM __t t JOIN __k k ON k.tile_r = t.tile_r AND k.tile_c = t.tile_c AND k.k = 1 GROUP BY t.tile_r, t.tile_c", "scene_cells")(lambda s, d: ops.tile_stats(_scene(s, d).select("r", "c", F.col("scl").cast("double").alias("v")), "v", 10))
query("band_profile", "SELECT min(v) AS min, max(v) AS max, round_even(avg(v), 6) AS mean, median(v) AS median, quantile_cont(v, 0.02) AS p2, quantile_cont(v, 0.98) AS p98, bool_and(v = floor(v)) AND count(DISTINCT v) <= 30 AS classified FROM (SELECT CAST(scl AS DOUBLE) AS v FROM scene_cells)", "scene_cells")(lambda s, d: ops.band_profile(_scene(s, d).select(F.col("scl").cast("double").alias("v")), "v"))
query("confusion_matrix", "SELECT y_true, y_pred, count(*) AS n FROM predictions WHERE y_true >= 0 AND y_pred >= 0 GROUP BY ALL", "predictions")(lambda s, d: ops.confusion(_pred(s, d)))
query("classification_metrics", "__v AS (SELECT * FROM predictions WHERE y_true >= 0 AND y_pred >= 0), __l AS (SELECT y_true AS l FROM __v UNION SELECT y_pred FROM __v), __c AS (SELECT l, (SELECT count(*) FROM __v WHERE y_true = l) AS support, (SELECT count(*) FROM __v WHERE y_pred = l) AS predicted, (SELECT count(*) FROM __v WHERE y_pred = l AND y_true = l) AS hit FROM __l), __r AS (SELECT *, coalesce(CAST(hit AS DOUBLE) / nullif(predicted, 0), 0) AS pr, coalesce(CAST(hit AS DOUBLE) / nullif(support, 0), 0) AS rc FROM __c), __f AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM __r) SELECT round_even(CAST(sum(hit) AS DOUBLE) / sum(support), 4) AS accuracy, round_even(CAST(max(support) AS DOUBLE) / sum(support), 4) AS baseline, round_even(avg(pr), 4) AS precision, round_even(avg(rc), 4) AS recall, round_even(avg(f1), 4) AS f1, round_even(sum(f1 * support) / sum(support), 4) AS f1_weighted FROM __f", "predictions")(lambda s, d: ops.classification_metrics(_pred(s, d)))
query("confusion_normalized", "__n AS (SELECT y_true, y_pred, count(*) AS n FROM predictions WHERE y_true >= 0 AND y_pred >= 0 GROUP BY ALL) SELECT y_true, y_pred, round_even(n / sum(n) OVER (PARTITION BY y_true), 6) AS share FROM __n", "predictions")(lambda s, d: ops.confusion_normalized(_pred(s, d)))
query("error_map", "SELECT vec_id, CASE WHEN y_true < 0 OR y_pred < 0 THEN 'ignored' WHEN y_true = y_pred THEN 'correct' ELSE 'wrong' END AS state FROM predictions", "predictions")(lambda s, d: ops.error_map(_pred(s, d), ["vec_id"]))
query("transition_matrix", "__g AS (SELECT from_class, to_class, count(*) AS cells FROM class_pairs GROUP BY ALL) SELECT *, round_even(cells * 100.0 / 10000, 3) AS hectares, round_even(cells * 100.0 / sum(cells) OVER (), 4) AS percent FROM __g", "class_pairs")(lambda s, d: ops.transition_matrix(view(s, d, "class_pairs"), 100.0))
_V = "__v AS (SELECT image_id, tile_id, coalesce(verdict, 'not_verifiable') AS verdict FROM tile_verdicts)"
query("verdict_rollup", f"{_V} SELECT image_id, count(*) AS tiles, round_even(count(*) FILTER (verdict IN ('correct', 'wrong')) * 100.0 / count(*), 1) AS verified_pct, CASE WHEN bool_or(verdict = 'wrong') THEN 'not_valid' WHEN bool_or(verdict IN ('unsure', 'needs_review')) THEN 'needs_review' WHEN bool_and(verdict = 'not_verifiable') THEN 'not_verifiable' WHEN NOT bool_or(verdict = 'correct') THEN 'needs_review' ELSE 'valid' END AS verdict FROM __v GROUP BY image_id", "tile_verdicts")(lambda s, d: ops.verdict_rollup(_tiles(s, d)))
query("verdict_consensus", "__k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY tile_id) AS k FROM tile_verdicts WHERE verdict IN ('wrong', 'unsure')) SELECT t.image_id, t.tile_id, CASE WHEN k.k <= 4 AND CASE WHEN t.tile_id % 3 = 0 THEN 'correct' ELSE t.verdict END <> t.verdict THEN 'needs_review' ELSE t.verdict END AS verdict FROM tile_verdicts t LEFT JOIN __k k ON k.image_id = t.image_id AND k.tile_id = t.tile_id", "tile_verdicts")(
    lambda s, d: ops.verdict_consensus(_tiles(s, d), _tiles(s, d).select("image_id", "tile_id", F.when(F.col("tile_id") % 3 == 0, "correct").otherwise(F.col("verdict")).alias("verdict")))
)
query("balance_weights", "__g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight FROM __g")(lambda s, d: ops.balance_weights(table(s, d, "embeddings"), "label").select("label", "n", F.col("weight").cast("double").alias("weight")))
_DEALT = "WITH __k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(vec_id AS VARCHAR) || '|' || CAST(label AS VARCHAR))) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings), __n AS (SELECT *, max(n) OVER () AS most, min(n) OVER () AS least FROM __k)"
query("oversample", f"{_DEALT} SELECT vec_id, label FROM (SELECT vec_id, label, unnest(range(most // n + CASE WHEN k < most % n THEN 1 ELSE 0 END)) FROM __n)")(lambda s, d: ops.resampled(table(s, d, "embeddings").select("vec_id", "label"), "label", "oversample"))
query("undersample", f"{_DEALT} SELECT vec_id, label FROM __n WHERE k < least")(lambda s, d: ops.resampled(table(s, d, "embeddings").select("vec_id", "label"), "label", "undersample"))
_XY = "(SELECT s_suppkey AS id, s_suppkey * 37 % 1000 / 10.0 AS x, s_suppkey * 91 % 1000 / 10.0 AS y FROM supplier)"


@query("spatial_split", f"WITH p AS {_XY}, q AS (SELECT quantile_cont(x, 0.8) AS cut FROM p), t AS (SELECT p.*, x < cut AS train FROM p, q) SELECT id, train FROM t WHERE train OR NOT EXISTS (SELECT 1 FROM t o WHERE o.train AND sqrt((o.x - t.x) * (o.x - t.x) + (o.y - t.y) * (o.y - t.y)) <= 3.0)")
def spatial_split(spark, sf_dir):
    """West part for training, east part for testing, test points near a training point left out."""
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37 % 1000 / 10.0).alias("x"), (F.col("s_suppkey") * 91 % 1000 / 10.0).alias("y"))
    return learning.spatial_split(p, 0.2, 3.0).select("id", "train")


_BRIGHT = "__r AS (SELECT red AS a, green AS b, blue AS c FROM refl WHERE green > 0.18 AND (red + green + blue) / 3.0 > 0.18)"
query("band_order", f"{_BRIGHT} SELECT count(*) AS bright, coalesce(count(*) > 100 AND median(c) > 1.2 * median(a) AND avg(CASE WHEN c > a * 1.15 THEN 1.0 ELSE 0.0 END) > 0.6, false) AS swapped FROM __r", "refl")(
    lambda s, d: learning.band_order(view(s, d, "refl"))
)
_BR = "(red + green + blue) / 3.0"
query("physical_gating", f"__k AS (SELECT *, CASE WHEN scl % 2 = 0 THEN 5 ELSE 2 END AS k, {_BR} AS br FROM refl WHERE red IS NOT NULL) SELECT r, c, CASE WHEN k = 5 AND (br > 0.26 OR red > 0.2 OR (red > 0.14 AND red > 1.2 * blue)) THEN CASE WHEN red > 1.1 * blue OR br > 0.35 THEN 0 ELSE 1 END ELSE k END AS cls FROM __k", "refl")(
    lambda s, d: view(s, d, "refl").filter("red is not null").select("r", "c", learning.physical_gating(F.when(F.col("scl") % 2 == 0, 5).otherwise(2), F.col("red"), F.col("green"), F.col("blue")).alias("cls"))
)
