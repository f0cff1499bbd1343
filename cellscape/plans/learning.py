"""Queries on learning (section J, B43, E19, E20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscape.operators import learning as ops
from cellscape.operators import series
from cellscape.plans.fixtures import table, view
from cellscape.plans.registry import ORACLES, query

_BANDS = [f"v{i}" for i in range(64)]


def vectors(spark, sf_dir):
    """Embeddings as rows of 64 features and a label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(b) for i, b in enumerate(_BANDS)])


def _fit(kind, **boosting):
    def run(spark, sf_dir):
        rows = vectors(spark, sf_dir)
        model = ops.fit(rows.filter("vec_id % 5 <> 0"), _BANDS, kind, **boosting)
        return model.transform(rows.filter("vec_id % 5 = 0")).select("vec_id", "label", "prediction")

    return run


query("fit_rf")(_fit("random_forest"))
query("fit_gbt")(_fit("gradient_boosting", rounds=20, depth=3))
query("fit_lr")(_fit("logistic_regression"))
query("train_report")(lambda s, d: ops.train_report(vectors(s, d), _BANDS, rounds=10, depth=3))


def rgb(spark, sf_dir):
    """Scene cells as gapless red, green and blue in 0..1 on the whole rectangle."""
    return view(spark, sf_dir, "rgb_cells")


_AT = {"mirror": lambda x, n: f"CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} >= {n} THEN 2 * {n} - 1 - ({x}) ELSE {x} END", "wrap": lambda x, n: f"({x} + {n}) % {n}"}


def _boxed(name, source, size, aggs, edge="mirror"):
    """DuckDB: a subquery (r, c, aggregates over the size x size box of source, whose cells are b and the box's own a)."""
    k = size // 2
    offsets = f"(SELECT unnest(range(-{k}, {k} + 1)) AS dr) CROSS JOIN (SELECT unnest(range(-{k}, {k} + 1)) AS dc)"
    return f"{name} AS (SELECT a.r, a.c, {aggs} FROM {source} a CROSS JOIN __h CROSS JOIN {offsets} JOIN {source} b ON b.r = {_AT[edge]('(a.r + dr)', 'h')} AND b.c = {_AT[edge]('(a.c + dc)', '40')} GROUP BY a.r, a.c)"


_mean = lambda x, size, name: f"sum({x}) / {size * size}.0 AS {name}"
_HORN = lambda x: f"sqrt(power(sum({x} * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END), 2) + power(sum({x} * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END), 2))"
_STD = lambda n: f"sqrt(greatest(0.0, {n}2 - {n} * {n}))"
_CELLS = ", ".join([
    "__v AS (SELECT r, c, red, green, blue, (red + green + blue) / 3.0 AS v, greatest(red, green, blue) AS hi, least(red, green, blue) AS lo FROM rgb_cells), __h AS (SELECT max(r) + 1 AS h FROM __v)",
    _boxed("__five", "__v", 5, ", ".join([_mean("b.v", 5, "mv"), _mean("b.v * b.v", 5, "mv2"), _mean("b.red", 5, "mr"), _mean("b.red * b.red", 5, "mr2"), _mean("b.green", 5, "mg"), _mean("b.green * b.green", 5, "mg2"), _mean("b.blue", 5, "mb"), _mean("b.blue * b.blue", 5, "mb2")])),
    _boxed("__edge", "__v", 3, f"{_HORN('b.v')} AS edge"), _boxed("__p90", "__edge", 5, _mean("b.edge", 5, "edge5")),
    _boxed("__n7", "__v", 7, _mean("b.v", 7, "m7")), _boxed("__n15", "__v", 15, _mean("b.v", 15, "m15")),
    "__off AS (SELECT r, c, abs(v - m7) AS near, abs(v - m15) AS far FROM __v JOIN __n7 USING (r, c) JOIN __n15 USING (r, c))",
    _boxed("__spread", "__off", 7, ", ".join([_mean("b.near", 7, "near7"), _mean("b.far", 7, "far7")])),
    _boxed("__fine", "__v", 3, _mean("b.v", 3, "ms_fine")), _boxed("__coarse", "__v", 31, _mean("b.v", 31, "ms_coarse")), _boxed("__energy", "__n7", 3, f"{_HORN('b.m7')} AS energy"),
    _boxed("__lbp", "__v", 3, "CAST(count(*) FILTER (b.v <= a.v AND NOT (dr = 0 AND dc = 0)) AS DOUBLE) AS k", "wrap"),
    "__all AS (SELECT * FROM __v JOIN __energy USING (r, c) JOIN __lbp USING (r, c))",
    _boxed("__wide", "__all", 15, ", ".join(_mean(f"b.{x}", 15, f"w_{x}") for x in ("hi", "lo", "green", "blue", "v", "energy", "k")) + ", " + ", ".join([_mean("b.k * b.k", 15, "k2"), _mean("CASE WHEN b.k IN (0, 8) THEN 1.0 ELSE 0.0 END", 15, "ku"), _mean("CASE WHEN b.k = 4 THEN 1.0 ELSE 0.0 END", 15, "km"), _mean("CASE WHEN b.k BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END", 15, "kv")])),
])
_clip = lambda x, lo, hi: f"greatest({lo}, least({hi}, {x}))"
_CELL14 = {
    "red": "red", "green": "green", "blue": "blue", "vari": _clip("coalesce((green - red) / nullif(green + red - blue + 1e-6, 0), 0.0)", -2.0, 2.0), "rb_ratio": _clip("red / (blue + 1e-6)", 0.0, 10.0), "ngrdi": _clip("(green - red) / (green + red + 1e-6)", -1.0, 1.0),
    "brightness": "v", "texture": _STD("mv"), "r_std": _STD("mr"), "g_std": _STD("mg"), "edge": "edge", "edge_p90": "edge5 * 1.5", "contrast": "near7 * 2.0", "quad_disp": "far7",
}
_CELL33 = _CELL14 | {
    "saturation": "(w_hi - w_lo) / (w_hi + 1e-6)", "gb_ratio": _clip("w_green / (w_blue + 1e-6)", 0.0, 10.0), "brightness_range": "near7 * 4.0", "fft_energy": _clip("w_energy", 0.0, 1e6), "rg_slope": _clip("(red - green) / (red + green + 1e-6)", -1.0, 1.0), "blue_dom": _clip("blue / (red + green + blue + 1e-6)", 0.0, 1.0),
    "ms_fine": "ms_fine", "ms_mid": "w_v", "ms_coarse": "ms_coarse", "ms_diff_fm": "abs(ms_fine - w_v)", "ms_diff_mc": "abs(w_v - ms_coarse)", "lbp_mean": "w_k", "lbp_std": "sqrt(greatest(0.0, k2 - w_k * w_k))", "lbp_uniform": "ku", "lbp_mixed": "km", "lbp_varied": "kv",
    "r_iqr": f"{_STD('mr')} * 1.35", "g_iqr": f"{_STD('mg')} * 1.35", "b_iqr": f"{_STD('mb')} * 1.35",
}
_JOINED = "__v " + " ".join(f"JOIN {t} USING (r, c)" for t in ("__five", "__edge", "__p90", "__spread", "__fine", "__coarse", "__wide"))
_5 = lambda df: df.select("r", "c", *[F.bround(n, 5).alias(n) for n in df.columns if n not in ("r", "c")])
for _name, _columns, _function in (("rgb_features", _CELL14, ops.rgb_features), ("rgb_features_33", _CELL33, ops.rgb_features_33)):
    query(_name, f"{_CELLS} SELECT r, c, " + ", ".join(f"round_even(CAST({x} AS DOUBLE), 5) AS {n}" for n, x in _columns.items()) + f" FROM {_JOINED}", "rgb_cells")(lambda s, d, f=_function: _5(f(rgb(s, d))))


def _scene_model(spark, sf_dir, columns):
    """A model of three classes by NIR thirds of the scene; its rows are dealt in parts, as each round of a forest reads them all."""
    cells = rgb(spark, sf_dir)
    # The scene has no gaps, so features beside those of the model leave out no row.
    cells = cells.withColumn("brightness", (F.col("red") + F.col("green") + F.col("blue")) / 3.0) if set(columns) <= {"red", "green", "blue", "brightness"} else ops.rgb_features(cells)
    label = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(2.0), (F.col("nir") - 1500) / 1200))).cast("double").alias("label")
    rows = cells.select("r", "c", *columns).join(view(spark, sf_dir, "scene_cells").select("r", "c", label), ["r", "c"]).dropna()
    return ops.fit(ops.dealt(rows, ["r", "c"]), columns, "random_forest")


@query("predict_cells")
def predict_cells(spark, sf_dir):
    columns = ["red", "green", "blue", "brightness"]
    return ops.predict_cells(_scene_model(spark, sf_dir, columns), view(spark, sf_dir, "refl").withColumn("brightness", (F.col("red") + F.col("green") + F.col("blue")) / 3.0), columns)


@query("classify_scene")
def classify_scene(spark, sf_dir):
    """Band order, features, model, physical gating, class names."""
    return ops.classify_scene(_scene_model(spark, sf_dir, list(ops.RGB14)), rgb(spark, sf_dir), {0: "bare", 1: "urban", 2: "vegetation", 5: "water"}, water=0)


# In DuckDB: each patch's cells with their places in it, neighbours by joins, and a sum of waves for each place of the ring.
_PATCH = """__c AS (SELECT CAST(floor(r / 10.0) AS BIGINT) * 100 + CAST(floor(c / 10.0) AS BIGINT) AS patch, r % 10 AS i, c % 10 AS j, red, green, blue, (red + green + blue) / 3.0 AS v FROM rgb_cells),
__s AS (SELECT patch, max(i) + 1 AS h, max(j) + 1 AS w FROM __c GROUP BY patch),
__p AS (SELECT c.*, h, w, floor(greatest(0.0, least(1.0, v)) * 255) AS u8, i >= h // 4 AND i < 3 * h // 4 AND j >= w // 4 AND j < 3 * w // 4 AS mid FROM __c c JOIN __s USING (patch)),
__o AS (SELECT unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) AS di, unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) AS dj),
__e AS (SELECT p.patch, p.i, p.j, sqrt(power(sum(n.v * dj * CASE WHEN di = 0 THEN 2 ELSE 1 END), 2) + power(sum(n.v * di * CASE WHEN dj = 0 THEN 2 ELSE 1 END), 2)) AS edge
  FROM __p p CROSS JOIN __o JOIN __p n ON n.patch = p.patch AND n.i = greatest(0, least(p.h - 1, p.i + di)) AND n.j = greatest(0, least(p.w - 1, p.j + dj)) GROUP BY p.patch, p.i, p.j),
__l AS (SELECT p.patch, p.i, p.j, count(*) FILTER (n.u8 <= p.u8) AS lbp FROM __p p CROSS JOIN (SELECT * FROM __o WHERE di <> 0 OR dj <> 0) JOIN __p n ON n.patch = p.patch AND n.i = (p.i + di + p.h) % p.h AND n.j = (p.j + dj + p.w) % p.w GROUP BY p.patch, p.i, p.j),
__r AS (SELECT patch, h, w, y - h // 2 AS fy, x - w // 2 AS fx FROM (SELECT patch, h, w, unnest(range(h)) AS y FROM __s) CROSS JOIN (SELECT unnest(range(10)) AS x) WHERE x < w AND power(y - h // 2, 2) + power(x - w // 2, 2) >= power(least(h, w) // 8, 2) AND power(y - h // 2, 2) + power(x - w // 2, 2) < power(least(h, w) // 4, 2)),
__m AS (SELECT r.patch, fy, fx, sqrt(power(sum(v * cos(2 * pi() * (fy * i / CAST(r.h AS DOUBLE) + fx * j / CAST(r.w AS DOUBLE)))), 2) + power(sum(v * sin(2 * pi() * (fy * i / CAST(r.h AS DOUBLE) + fx * j / CAST(r.w AS DOUBLE)))), 2)) AS mag FROM __r r JOIN __p p USING (patch) GROUP BY r.patch, fy, fx),
__f AS (SELECT patch, avg(mag) AS energy FROM __m GROUP BY patch),
__g AS (SELECT patch, avg(red) FILTER (mid) AS red, avg(green) FILTER (mid) AS green, avg(blue) FILTER (mid) AS blue, avg(v) AS brightness, stddev_pop(v) AS texture, stddev_pop(red) AS r_std, stddev_pop(green) AS g_std, avg(edge) AS edge_mag, quantile_cont(edge, 0.9) AS edge_p90,
  quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS contrast, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS brightness_range, avg(v) FILTER (i < h // 2 AND j < w // 2) AS q0, avg(v) FILTER (i < h // 2 AND j >= w // 2) AS q1, avg(v) FILTER (i >= h // 2 AND j < w // 2) AS q2, avg(v) FILTER (i >= h // 2 AND j >= w // 2) AS q3,
  avg(v) AS f1, avg(v) FILTER (i % 2 = 0 AND j % 2 = 0) AS f2, avg(v) FILTER (i % 4 = 0 AND j % 4 = 0) AS f4, avg(greatest(red, green, blue) - least(red, green, blue)) FILTER (mid) AS wide, avg(greatest(red, green, blue)) FILTER (mid) AS top,
  avg(lbp) AS lbp_mean, stddev_pop(lbp) AS lbp_std, count(*) FILTER (lbp IN (0, 7, 8)) / (count(*) + 1e-6) AS lbp_uniform, count(*) FILTER (lbp = 4) / (count(*) + 1e-6) AS lbp_mixed, count(*) FILTER (lbp BETWEEN 1 AND 3) / (count(*) + 1e-6) AS lbp_varied,
  quantile_cont(red, 0.75) FILTER (mid) - quantile_cont(red, 0.25) FILTER (mid) AS r_iqr, quantile_cont(green, 0.75) FILTER (mid) - quantile_cont(green, 0.25) FILTER (mid) AS g_iqr, quantile_cont(blue, 0.75) FILTER (mid) - quantile_cont(blue, 0.25) FILTER (mid) AS b_iqr
  FROM __p JOIN __e USING (patch, i, j) JOIN __l USING (patch, i, j) GROUP BY patch),
__q AS (SELECT *, (q0 + q1 + q2 + q3) / 4 AS qm FROM __g LEFT JOIN __f USING (patch))"""
_FEATURES = {
    "vari": "greatest(-2.0, least(2.0, (green - red) / (green + red - blue + 1e-6)))", "rb_ratio": "greatest(0.0, least(10.0, red / (blue + 1e-6)))", "ngrdi": "greatest(-1.0, least(1.0, (green - red) / (green + red + 1e-6)))",
    "quad_disp": "sqrt((power(q0 - qm, 2) + power(q1 - qm, 2) + power(q2 - qm, 2) + power(q3 - qm, 2)) / 4)", "saturation": "wide / (top + 1e-6)", "gb_ratio": "greatest(0.0, least(10.0, green / (blue + 1e-6)))", "fft_energy": "greatest(0.0, least(1e6, coalesce(energy, 0.0)))",
    "rg_slope": "greatest(-1.0, least(1.0, (red - green) / (red + green + 1e-6)))", "blue_dom": "greatest(0.0, least(1.0, blue / (red + green + blue + 1e-6)))", "ms_mean_fine": "f1", "ms_mean_mid": "f2", "ms_mean_coarse": "f4", "ms_diff_fm": "abs(f1 - f2)", "ms_diff_mc": "abs(f2 - f4)",
}


def _patches(names):
    def run(spark, sf_dir):
        cells = rgb(spark, sf_dir).withColumn("patch", F.floor(F.col("r") / 10.0) * 100 + F.floor(F.col("c") / 10.0))
        return ops.patch_features(cells, "patch", names).select("patch", *[F.bround(n, 6).alias(n) for n in names])

    return run


for _name, _names in (("patch_features", ops.PATCH33), ("patch_features_14", ops.PATCH14)):
    query(_name, f"{_PATCH} SELECT patch, " + ", ".join(f"round_even({_FEATURES.get(n, n)}, 6) AS {n}" for n in _names) + " FROM __q", "rgb_cells")(_patches(_names))
_X = "__x AS (SELECT cell, d, y, date_diff('day', (SELECT min(d) FROM cell_series), d) / 365.2425 AS x FROM cell_series), __g AS (SELECT cell, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM __x GROUP BY cell HAVING count(*) >= 3)"



@query("series_with_trend", f"{_X.replace('__g', '__ols')}, __m AS ({ORACLES['cusum']}) SELECT x.cell, x.d, round_even(y, 5) AS y, round_even(a + b * x, 5) AS trend, coalesce(row_number() OVER (PARTITION BY x.cell ORDER BY x.d) - 1 = m.first, false) AS change FROM __x x JOIN __ols USING (cell) LEFT JOIN __m m ON m.cell = x.cell", "cell_series")
def series_with_trend(spark, sf_dir):
    """Each value beside its trend, marked where the cell's first change is."""
    s = view(spark, sf_dir, "cell_series").select("cell", "d", "y")
    return series.with_trend(s, series.cusum(s)).select("cell", "d", F.bround("y", 5).alias("y"), F.bround("trend", 5).alias("trend"), "change")
