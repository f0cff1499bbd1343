"""Land-cover learning on tables with MLlib: features, models, prediction, reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.operators import focal, vector
from cellscape.operators.boosting import boosted, in_threads
from cellscape.operators.quantiles import quantiles, with_quantiles
from cellscape.operators.ranks import shuffled
from cellscape.operators.stacks import TILE, Patch, in_tiles
from cellscape.operators.summaries import balance_weights, classification_metrics
from cellscape.sources.scratch import stored

RGB14 = ("red", "green", "blue", "vari", "rb_ratio", "ngrdi", "brightness", "texture", "r_std", "g_std", "edge", "edge_p90", "contrast", "quad_disp")


def clipped(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def colour_features(r: Column, g: Column, b: Column, eps: float = 1e-6) -> dict[str, Column]:
    return {
        "vari": clipped(F.coalesce(F.try_divide(g - r, g + r - b + eps), F.lit(0.0)), -2.0, 2.0),
        "rb_ratio": clipped(r / (b + eps), 0.0, 10.0),
        "ngrdi": clipped((g - r) / (g + r + eps), -1.0, 1.0),
        "brightness": (r + g + b) / 3.0,
    }


MORE19 = (
    "saturation", "gb_ratio", "brightness_range", "fft_energy", "rg_slope", "blue_dom", "ms_fine", "ms_mid", "ms_coarse", "ms_diff_fm", "ms_diff_mc", "lbp_mean", "lbp_std", "lbp_uniform", "lbp_mixed", "lbp_varied",
    "r_iqr", "g_iqr", "b_iqr",
)


def _spread(patch: Patch, a: np.ndarray) -> np.ndarray:
    """Population deviation over boxes of 5 x 5."""
    m = patch.mean(a, 5)
    return np.sqrt(np.maximum(0.0, patch.mean(a * a, 5) - m * m))


def _rgb14(patch: Patch, eps: float = 1e-6) -> dict[str, np.ndarray]:
    # Fixed values of the feature sets, here and below: eps, the factors 1.5, 2.0 and 1.35, and the sizes of boxes.
    r, g, b = (patch.layers[n] for n in ("red", "green", "blue"))
    v, whole = (r + g + b) / 3.0, g + r - b + eps
    edge = patch.slope(v)
    vari = np.divide(g - r, whole, out=np.zeros_like(v), where=whole != 0)
    return {
        "red": r, "green": g, "blue": b, "vari": np.clip(vari, -2.0, 2.0), "rb_ratio": np.clip(r / (b + eps), 0.0, 10.0), "ngrdi": np.clip((g - r) / (g + r + eps), -1.0, 1.0), "brightness": v,
        "texture": _spread(patch, v), "r_std": _spread(patch, r), "g_std": _spread(patch, g), "edge": edge, "edge_p90": patch.mean(edge, 5) * 1.5,
        "contrast": patch.mean(np.abs(v - patch.mean(v, 7)), 7) * 2.0, "quad_disp": patch.mean(np.abs(v - patch.mean(v, 15)), 7),
    }


def _rgb33(patch: Patch, eps: float = 1e-6) -> dict[str, np.ndarray]:
    out = _rgb14(patch, eps)
    r, g, b, v = (out[n] for n in ("red", "green", "blue", "brightness"))
    k = patch.pattern(lambda pdf: (pdf["red"].to_numpy() + pdf["green"].to_numpy() + pdf["blue"].to_numpy()) / 3.0)
    wide = lambda a: patch.mean(a, 15)
    flag = lambda c: wide(c.astype(np.float64))
    hi, lo, fine, mid, coarse, mean = wide(np.maximum(np.maximum(r, g), b)), wide(np.minimum(np.minimum(r, g), b)), patch.mean(v, 3), wide(v), patch.mean(v, 31), wide(k)
    return out | {
        "saturation": (hi - lo) / (hi + eps), "gb_ratio": np.clip(wide(g) / (wide(b) + eps), 0.0, 10.0), "brightness_range": out["contrast"] * 2.0, "fft_energy": np.clip(wide(patch.slope(patch.mean(v, 7))), 0.0, 1e6),
        "rg_slope": np.clip((r - g) / (r + g + eps), -1.0, 1.0), "blue_dom": np.clip(b / (r + g + b + eps), 0.0, 1.0), "ms_fine": fine, "ms_mid": mid, "ms_coarse": coarse, "ms_diff_fm": np.abs(fine - mid), "ms_diff_mc": np.abs(mid - coarse),
        "lbp_mean": mean, "lbp_std": np.sqrt(np.maximum(0.0, wide(k * k) - mean * mean)), "lbp_uniform": flag((k == 0) | (k == 8)), "lbp_mixed": flag(k == 4), "lbp_varied": flag((k >= 1) & (k <= 3)),
        "r_iqr": out["r_std"] * 1.35, "g_iqr": out["g_std"] * 1.35, "b_iqr": _spread(patch, b) * 1.35,
    }


def rgb_features(cells: DataFrame, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """(…, r, c, 14 features) of cells with red, green and blue in 0..1 and no gaps: colours, local deviations, edges, contrasts."""
    return in_tiles(cells, ("red", "green", "blue"), _rgb14, RGB14, by, tile)


def rgb_features_33(cells: DataFrame, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """(…, r, c, 33 features): the 14, then saturation, ratios, smoothed edge energy, means at three scales, local binary patterns and spreads.

    Cells travel once, in tiles with a halo, and all boxes are made inside a task.
    """
    return in_tiles(cells, ("red", "green", "blue"), _rgb33, RGB14 + MORE19, by, tile)


PATCH14 = ("red", "green", "blue", "vari", "rb_ratio", "ngrdi", "brightness", "texture", "r_std", "g_std", "edge_mag", "edge_p90", "contrast", "quad_disp")
PATCH33 = (
    *PATCH14, "saturation", "gb_ratio", "brightness_range", "fft_energy", "rg_slope", "blue_dom", "ms_mean_fine", "ms_mean_mid", "ms_mean_coarse", "ms_diff_fm", "ms_diff_mc",
    "lbp_mean", "lbp_std", "lbp_uniform", "lbp_mixed", "lbp_varied", "r_iqr", "g_iqr", "b_iqr",
)


def ring_energy(values: pd.Series, width: pd.Series) -> pd.Series:
    """Mean Fourier magnitude of images (rows end to end, of a given width) on the ring between an eighth and a quarter of the shorter side."""

    def one(v: np.ndarray, w: int) -> float:
        image = np.asarray(v, float).reshape(-1, w)
        h = len(image)
        fy, fx = np.arange(h) - h // 2, np.arange(w) - w // 2
        far = fy[:, None] ** 2 + fx[None, :] ** 2
        ring = (far >= (min(h, w) // 8) ** 2) & (far < (min(h, w) // 4) ** 2)
        return float(np.abs(np.fft.fftshift(np.fft.fft2(image)))[ring].mean()) if ring.any() else 0.0

    return pd.Series([one(v, int(w)) for v, w in zip(values, width)])


def patch_features(cells: DataFrame, patch: str, names: Sequence[str] = PATCH33) -> DataFrame:
    """(patch, features) of image patches: cells (patch, r, c, red, green, blue) in 0..1, whole rectangles without gaps.

    Means of the centre half, colour ratios of those, deviations, Sobel edges, percentile spreads, quarters, three scales, local binary
    patterns and ring energy; a patch is a small image of fixed size, and only the ring energy is computed outside the JVM.
    """
    eps, by = 1e-6, (patch,)
    x = focal.extents(cells.select(patch, "r", "c", "red", "green", "blue"), by).withColumn("v", (F.col("red") + F.col("green") + F.col("blue")) / 3.0)
    x = focal.horn(x, by).withColumn("edge", F.hypot("gx", "gy")).drop("gx", "gy")
    x = x.withColumn("u8", F.floor(clipped(F.col("v"), 0.0, 1.0) * 255))
    n9 = focal.gather3(x, "u8", by, "wrap")
    k = F.size(F.filter(F.concat(F.slice("n9", 1, 4), F.slice("n9", 6, 4)), lambda o: o <= F.col("u8")))
    x = n9.withColumn("lbp", k.cast("double")).drop("n9", "u8")
    i, j, h, w = F.col("r") - F.col("__r0"), F.col("c") - F.col("__c0"), F.col("__r1") - F.col("__r0") + 1, F.col("__c1") - F.col("__c0") + 1
    centre = (i >= F.floor(h / 4)) & (i < F.floor(3 * h / 4)) & (j >= F.floor(w / 4)) & (j < F.floor(3 * w / 4))
    south, east = i >= F.floor(h / 2), j >= F.floor(w / 2)
    inner = {n: F.when(centre, F.col(n)) for n in ("red", "green", "blue")}
    top, low = F.greatest("red", "green", "blue"), F.least("red", "green", "blue")
    share = lambda c: F.count_if(c) / (F.count("*") + eps)
    spread = lambda c, *p: F.percentile(c, F.array(*map(F.lit, p)))
    g = x.groupBy(patch).agg(
        *[F.avg(c).alias(n) for n, c in inner.items()], F.avg("v").alias("brightness"), F.stddev_pop("v").alias("texture"), F.stddev_pop("red").alias("r_std"), F.stddev_pop("green").alias("g_std"),
        F.avg("edge").alias("edge_mag"), F.percentile("edge", F.lit(0.9)).alias("edge_p90"), spread("v", 0.1, 0.9, 0.05, 0.95).alias("p"),
        *[F.avg(F.when((south == a) & (east == b), F.col("v"))).alias(f"q{2 * a + b}") for a in (False, True) for b in (False, True)],
        *[F.avg(F.when((i % step == 0) & (j % step == 0), F.col("v"))).alias(n) for step, n in ((1, "ms_mean_fine"), (2, "ms_mean_mid"), (4, "ms_mean_coarse"))],
        F.avg(F.when(centre, top - low)).alias("wide"), F.avg(F.when(centre, top)).alias("top"), F.avg("lbp").alias("lbp_mean"), F.stddev_pop("lbp").alias("lbp_std"),
        # The eighth bin of the patterns holds 7 and 8.
        share(F.col("lbp").isin(0, 7, 8)).alias("lbp_uniform"), share(F.col("lbp") == 4).alias("lbp_mixed"), share(F.col("lbp").between(1, 3)).alias("lbp_varied"),
        *[spread(c, 0.25, 0.75).alias(f"{n[0]}_p") for n, c in inner.items()],
        F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "v"))), lambda o: o["v"]).alias("image"), F.max(w).alias("w"),
    )
    q = [F.col(f"q{n}") for n in range(4)]
    mean = (q[0] + q[1] + q[2] + q[3]) / 4.0
    r, gr, b = F.col("red"), F.col("green"), F.col("blue")
    colours = colour_features(r, gr, b)
    more = {n: colours[n] for n in ("vari", "rb_ratio", "ngrdi")} | {
        "contrast": F.col("p")[1] - F.col("p")[0],
        "quad_disp": F.sqrt(sum(((v - mean) * (v - mean) for v in q), F.lit(0.0)) / 4.0),
        "saturation": F.col("wide") / (F.col("top") + eps),
        "gb_ratio": clipped(gr / (b + eps), 0.0, 10.0),
        "brightness_range": F.col("p")[3] - F.col("p")[2],
        "fft_energy": clipped(F.pandas_udf(ring_energy, "double")("image", "w"), 0.0, 1e6),
        "rg_slope": clipped((r - gr) / (r + gr + eps), -1.0, 1.0),
        "blue_dom": clipped(b / (r + gr + b + eps), 0.0, 1.0),
        "ms_diff_fm": F.abs(F.col("ms_mean_fine") - F.col("ms_mean_mid")),
        "ms_diff_mc": F.abs(F.col("ms_mean_mid") - F.col("ms_mean_coarse")),
        **{f"{n}_iqr": F.col(f"{n}_p")[1] - F.col(f"{n}_p")[0] for n in "rgb"},
    }
    return g.select(patch, *[more.get(n, F.col(n)).alias(n) for n in names])


def classifier(kind: str = "random_forest", seed: int = 42, features: str = "features", label: str = "label", weight: str | None = None):
    """A forest of 100 trees, or logistic regression; boosted trees are fitted by `fit`."""
    more = {} if weight is None else {"weightCol": weight}
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=100, seed=seed, featuresCol=features, labelCol=label, **more)
    if kind == "logistic_regression":
        return LogisticRegression(maxIter=1000, featuresCol=features, labelCol=label, **more)
    raise ValueError("kind must be random_forest, gradient_boosting or logistic_regression")


def fit(rows: DataFrame, columns: Sequence[str], kind: str = "random_forest", label: str = "label", seed: int = 42, balanced: bool = False, **boosting) -> PipelineModel:
    """The fitted pipeline; `balanced` weighs each class by all rows / (classes * its rows).

    Boosted trees keep every eighth row of each class aside and stop when it gets no better; `boosting` has their rounds, depth and step.
    """
    if balanced:
        weights = balance_weights(rows, label).select(F.col("label").alias("__label"), F.col("weight").alias("__weight"))
        rows = rows.join(F.broadcast(weights), F.col(label) == F.col("__label"))
    weight, assembler = "__weight" if balanced else None, VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip")
    if kind == "gradient_boosting":
        split = shuffled(rows, [label], [label, *columns], seed, "__k").withColumn("__aside", F.col("__k") % 8 == 3)
        return PipelineModel([assembler, boosted(assembler.transform(split), "features", label, "__aside", weight, seed, **boosting)])
    return Pipeline(stages=[assembler, classifier(kind, seed, label=label, weight=weight)]).fit(rows)


def dealt(rows: DataFrame, by: Sequence[str], size: int = 25_000) -> DataFrame:
    """rows, written once, in parts of about `size` by a hash of the columns `by`, and in their order inside a part.

    Each round of a fit then has as many tasks as the rows need, however small their bytes are, and a forest's samples, which are drawn by part,
    do not depend on the cluster.
    """
    kept = stored(rows)
    return kept.repartition(max(1, -(-kept.count() // size)), *by).sortWithinPartitions(*by)


def predict_cells(model: Transformer, cells: DataFrame, columns: Sequence[str], nodata: float = -9999.0) -> DataFrame:
    """(r, c, prediction): the model's class where every feature is there, else the no-data value; no join.

    Cells are dealt anew first: a row's bytes are few and its trees many, so parts by bytes would be few long tasks.
    """
    whole = F.lit(True)
    for n in columns:
        whole = whole & F.col(n).isNotNull() & ~F.isnan(n)
    # Only the plain columns are dealt; the tests for missing values come after.
    plain = cells.select("r", "c", *columns).repartition("r", "c")
    filled = plain.select("r", "c", whole.alias("__ok"), *[F.when(whole, F.col(n)).otherwise(0.0).alias(n) for n in columns])
    return model.transform(filled).select("r", "c", F.when(F.col("__ok"), F.col("prediction")).otherwise(nodata).alias("prediction"))


def stratified(rows: DataFrame, label: str, by: Sequence[str], seed: int = 42, folds: int = 5) -> DataFrame:
    """rows with `held_out` (every fifth row of each class, in a seeded order of the columns `by`) and `fold` of the others."""
    ranked = shuffled(rows, [label], list(by), seed, "__k")
    return ranked.withColumns({"held_out": F.col("__k") % 5 == 4, "fold": (F.floor(F.col("__k") / 5) * 4 + F.col("__k") % 5) % folds}).drop("__k")


def spatial_split(points: DataFrame, test_share: float = 0.2, buffer: float = 0.0) -> DataFrame:
    """points (id, x, y, ...) with `train`: the west part trains, the east part tests; test points within `buffer` of a training point are left out."""
    t = with_quantiles(points, {"__cut": ("x", (1 - test_share,))}).withColumn("train", F.col("x") < F.col("__cut")[0]).drop("__cut")
    if buffer <= 0:
        return t
    near = vector.within_distance(t.filter("not train"), t.filter("train"), buffer).select(F.col("left_id").alias("id")).distinct()
    return t.join(near, "id", "left_anti")


def train_report(rows: DataFrame, columns: Sequence[str], label: str = "label", kind: str = "gradient_boosting", folds: int = 5, seed: int = 42, **boosting) -> DataFrame:
    """One row: metrics on a stratified fifth held out, the mean and deviation of the folds' accuracy, and the rounds that boosting kept (its longest class); classes weigh alike.

    The folds and the whole are fitted side by side on one written split.
    """
    split = stored(stratified(rows, label, [label, *columns], seed, folds))
    train, test = split.filter("not held_out"), split.filter("held_out")
    pairs = lambda m, d: m.transform(d).select(F.col(label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
    parts = [train, *(train.filter(F.col("fold") != k) for k in range(folds))]
    models = in_threads(lambda d: fit(d, columns, kind, label, seed, True, **boosting), parts)
    held = classification_metrics(pairs(models[0], test))
    scores = None
    for k, model in enumerate(models[1:]):
        one = classification_metrics(pairs(model, train.filter(F.col("fold") == k))).select("accuracy")
        scores = one if scores is None else scores.union(one)
    kept = max(getattr(models[0].stages[-1], "rounds", [0]))
    report = held.crossJoin(F.broadcast(scores.agg(F.bround(F.avg("accuracy"), 4).alias("cv_accuracy"), F.bround(F.stddev_pop("accuracy"), 4).alias("cv_std"))))
    return report.withColumn("rounds", F.lit(kept))


def band_order(cells: DataFrame) -> DataFrame:
    """One row (bright, swapped): whether bright cells are so much bluer than red that red and blue must have been exchanged."""
    bright = cells.filter("green > 0.18 and (red + green + blue) / 3.0 > 0.18")
    bluer = F.avg((F.col("blue") > F.col("red") * 1.15).cast("double")) > 0.6
    middle = quantiles(bright, {"__r": ("red", (0.5,)), "__b": ("blue", (0.5,))})
    found = bright.agg(F.count("*").alias("bright"), bluer.alias("__bluer")).crossJoin(F.broadcast(middle))
    return found.select("bright", F.coalesce((F.col("bright") > 100) & (F.col("__b")[0] > 1.2 * F.col("__r")[0]) & F.col("__bluer"), F.lit(False)).alias("swapped"))


def in_band_order(cells: DataFrame) -> DataFrame:
    """cells with red and blue exchanged back where band_order says so."""
    flagged = cells.crossJoin(F.broadcast(band_order(cells).select(F.col("swapped").alias("__swapped"))))
    pick = lambda a, b: F.when(F.col("__swapped"), F.col(b)).otherwise(F.col(a))
    return flagged.withColumns({"red": pick("red", "blue"), "blue": pick("blue", "red")}).drop("__swapped")


def physical_gating(cls: Column, r: Column, g: Column, b: Column) -> Column:
    """Class 5 (water) that is bright, red or warm becomes 0 (bare) or 1 (urban)."""
    bright = (r + g + b) / 3.0
    false_water = (cls == 5) & ((bright > 0.26) | (r > 0.20) | ((r > 0.14) & (r > 1.20 * b)))
    return F.when(false_water & ((r > 1.10 * b) | (bright > 0.35)), 0).when(false_water, 1).otherwise(cls)


def classify_scene(model: Transformer, cells: DataFrame, names: dict[int, str], water: int = 5) -> DataFrame:
    """(r, c, cls, name) of gapless red, green and blue cells: band order mended, features, the model's class, and the gating of water."""
    features = rgb_features(in_band_order(cells))
    found = model.transform(features).withColumn("__cls", F.when(F.col("prediction") == water, 5).otherwise(F.col("prediction").cast("int")))
    named = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return found.select("r", "c", physical_gating(F.col("__cls"), F.col("red"), F.col("green"), F.col("blue")).alias("cls")).withColumn("name", named[F.col("cls")])
