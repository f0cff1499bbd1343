"""Statistics of cells, masks, points, classes and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellscape.operators.cells import with_scalars
from cellscape.operators.quantiles import quantiles, with_quantiles
from cellscape.operators.ranks import shuffled


def raster_stats(cells: DataFrame, band: str, by: Sequence[str] = ()) -> DataFrame:
    """Valid and missing counts, extremes, mean, population deviation and linear percentiles of each raster."""
    ps = (0.05, 0.25, 0.5, 0.75, 0.95)
    g = cells.groupBy(*by).agg(F.count(band).alias("valid"), (F.count("*") - F.count(band)).alias("nodata"), F.min(band).alias("min"), F.max(band).alias("max"), F.bround(F.avg(band), 6).alias("mean"), F.bround(F.stddev_pop(band), 6).alias("std"))
    spread = quantiles(cells, {"p": (band, ps)}, by)
    g = g.join(spread, list(by)) if by else g.crossJoin(spread)
    return g.select(*by, "valid", "nodata", "min", "max", "mean", "std", *[F.col("p")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(ps)])


def area_stats(cells: DataFrame, selected: Column, valid: Column, cell_m2: float | None) -> DataFrame:
    """Selected and valid cells, percentage (4 decimals), hectares (3 decimals, only for a grid in metres)."""
    g = cells.agg(F.count_if(selected & valid).alias("selected"), F.count_if(valid).alias("valid"))
    hectares = F.bround(F.col("selected") * cell_m2 / 10000, 3) if cell_m2 is not None else F.lit(None).cast("double")
    return g.withColumn("percent", F.bround(F.try_divide(F.col("selected") * 100.0, F.col("valid")), 4)).withColumn("hectares", hectares)


def quadrants(cells: DataFrame, selected: Column) -> DataFrame:
    """Percentage of the selected cells in each quadrant, split at half the rows and columns; 0 if none is selected."""
    g = with_scalars(cells, (), F.floor((F.max("r") + 1) / 2).alias("h"), F.floor((F.max("c") + 1) / 2).alias("w"))
    part = lambda north, west: F.count_if(selected & ((F.col("r") < F.col("h")) == north) & ((F.col("c") < F.col("w")) == west))
    share = lambda n: F.coalesce(F.bround(F.try_divide(n * 100.0, F.count_if(selected)), 2), F.lit(0.0))
    return g.agg(share(part(True, True)).alias("north_west"), share(part(True, False)).alias("north_east"), share(part(False, True)).alias("south_west"), share(part(False, False)).alias("south_east"))


def points_to_grid(points: DataFrame, size: float = 1.0) -> DataFrame:
    """(r, c, dsm, dtm): highest and lowest z in each cell, row 0 at the largest y; clipped to the grid."""
    g = with_scalars(points, (), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    rows, cols = F.greatest(F.lit(1), F.ceil((F.col("y1") - F.col("y0")) / size)), F.greatest(F.lit(1), F.ceil((F.col("x1") - F.col("x0")) / size))
    r = F.least(rows - 1, F.greatest(F.lit(0), F.floor((F.col("y1") - F.col("y")) / size)))
    c = F.least(cols - 1, F.greatest(F.lit(0), F.floor((F.col("x") - F.col("x0")) / size)))
    return g.groupBy(r.alias("r"), c.alias("c")).agg(F.max("z").alias("dsm"), F.min("z").alias("dtm"))


def canopy_height(dsm: Column, dtm: Column, least: float = 0.0, most: float = 120.0) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), dsm - dtm))


def canopy_layer(height: Column, shrub: float = 2.0, understory: float = 5.0, canopy: float = 15.0) -> Column:
    """0 below 0.5 or missing, then 1, 2, 3, 4 by the thresholds."""
    return F.when(height.isNull() | (height < 0.5), 0).when(height < shrub, 1).when(height < understory, 2).when(height < canopy, 3).otherwise(4)


def canopy_metrics(cells: DataFrame, height: str, cell_m2: float = 1.0) -> DataFrame:
    """One row over vegetation (height of 1 or more): areas, cover, height statistics, volume; zeros where there is none."""
    tall = F.when(F.col(height) >= 1.0, F.col(height))
    zero = lambda c: F.coalesce(F.bround(c, 2), F.lit(0.0))
    g = cells.agg(
        F.bround(F.count(height) * cell_m2, 2).alias("total_m2"), F.bround(F.count(tall) * cell_m2, 2).alias("canopy_m2"), zero(F.try_divide(F.count(tall) * 100.0, F.count(height))).alias("cover"),
        zero(F.avg(tall)).alias("mean"), zero(F.max(tall)).alias("max"), zero(F.stddev_pop(tall)).alias("std"), zero(F.sum(tall) * cell_m2).alias("volume"),
    )
    spread = quantiles(cells, {"p": (tall, (0.5, 0.95))})
    return g.crossJoin(spread.select(*[zero(F.col("p")[i]).alias(n) for i, n in enumerate(("p50", "p95"))]))


def histogram(cells: DataFrame, band: str, bins: int = 128, by: Sequence[str] = ()) -> DataFrame:
    """(…, bin, n, lo, hi) between the 0.5th and 99.5th percentile, the upper end inclusive."""
    x = with_quantiles(cells.filter(F.col(band).isNotNull()), {"__p": (band, (0.005, 0.995))}, by)
    lo, hi = F.col("__p")[0], F.col("__p")[1]
    at = F.least(F.lit(bins - 1), F.floor((F.col(band) - lo) / (hi - lo) * bins))
    return x.filter((hi > lo) & (F.col(band) >= lo) & (F.col(band) <= hi)).groupBy(*by, at.alias("bin"), lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("n"))


def otsu(cells: DataFrame, band: str, bins: int = 128, by: Sequence[str] = ()) -> DataFrame:
    """(…, threshold): the bin centre with the largest between-class variance; cumulative sums over at most `bins` rows a raster."""
    h = histogram(cells, band, bins, by).withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    upto, whole = W.partitionBy(*(by or [F.lit(1)])).orderBy("bin"), W.partitionBy(*(by or [F.lit(1)]))
    h = h.withColumns({"w": F.sum("n").over(upto) / F.sum("n").over(whole), "m": F.sum(F.col("n") * F.col("centre")).over(upto) / F.sum("n").over(whole), "mt": F.sum(F.col("n") * F.col("centre")).over(whole) / F.sum("n").over(whole)})
    d = F.col("w") * (1 - F.col("w"))
    between = F.when(d > 1e-12, (F.col("mt") * F.col("w") - F.col("m")) * (F.col("mt") * F.col("w") - F.col("m")) / d).otherwise(0.0)
    return h.groupBy(*by).agg(F.max_by("centre", F.struct(F.bround(between, 9), -F.col("bin"))).alias("threshold"))


def _peaks(counts: np.ndarray, prominence: float = 0.03, sigma: float = 2.0) -> int:
    """Peaks of the smoothed counts whose prominence is at least that share of the highest."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    h = np.convolve(np.pad(counts.astype(float), reach, mode="symmetric"), kernel / kernel.sum(), "valid")
    found = 0
    for i in np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] >= h[2:])) + 1:
        higher_l, higher_r = np.flatnonzero(h[:i] > h[i]), np.flatnonzero(h[i + 1 :] > h[i])
        left = h[(higher_l[-1] if len(higher_l) else 0) : i + 1].min()
        right = h[i : (i + 2 + higher_r[0] if len(higher_r) else len(h))].min()
        found += h[i] - max(left, right) >= prominence * h.max()
    return int(found)


def bimodality(cells: DataFrame, band: str, bins: int = 128, by: Sequence[str] = ()) -> DataFrame:
    """(…, valid, threshold, d, peaks, bimodal): Ashman's D of the Otsu classes and peaks of the smoothed histogram; below 100 values never bimodal."""
    keys = list(by) or ["__one"]
    if not by:
        cells = cells.withColumn("__one", F.lit(1))
    t = cells.join(otsu(cells, band, bins, keys), keys)
    lo, hi = F.when(F.col(band) <= F.col("threshold"), F.col(band)), F.when(F.col(band) > F.col("threshold"), F.col(band))
    g = t.groupBy(*keys, "threshold").agg(F.count(band).alias("valid"), F.avg(lo).alias("m1"), F.avg(hi).alias("m2"), F.stddev_pop(lo).alias("s1"), F.stddev_pop(hi).alias("s2"))
    g = g.withColumn("d", F.coalesce(F.try_divide(F.lit(2.0**0.5) * F.abs(F.col("m1") - F.col("m2")), F.hypot("s1", "s2")), F.lit(0.0)))
    schema = ", ".join(f"{n} {k}" for n, k in cells.select(*keys).dtypes) + ", peaks int"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(bins)
        counts[pdf["bin"].to_numpy()] = pdf["n"]
        return pdf[keys].head(1).assign(peaks=_peaks(counts))

    peaks = histogram(cells, band, bins, keys).groupBy(*keys).applyInPandas(one, schema)
    out = g.join(peaks, keys).select(*keys, "valid", "threshold", F.bround("d", 3).alias("d"), "peaks", ((F.col("valid") >= 100) & ((F.col("d") >= 4.0) | ((F.col("peaks") >= 2) & (F.col("d") >= 3.8)))).alias("bimodal"))
    return out if by else out.drop("__one")


def adaptive_threshold(cells: DataFrame, band: str, block: int = 256, invert: bool = False) -> DataFrame:
    """(r, c, value): in bimodal blocks 1 at or above the block's threshold (at or below if inverted), else 0; missing cells null."""
    tiled = cells.withColumns({"tile_r": F.floor(F.col("r") / block), "tile_c": F.floor(F.col("c") / block)})
    t = tiled.join(bimodality(tiled, band, by=("tile_r", "tile_c")).select("tile_r", "tile_c", "threshold", "bimodal"), ["tile_r", "tile_c"], "left")
    hit = F.col("bimodal") & (F.col(band) <= F.col("threshold") if invert else F.col(band) >= F.col("threshold"))
    return t.select("r", "c", F.when(F.col(band).isNotNull(), F.coalesce(hit, F.lit(False)).cast("int")).alias("value"))


def tile_stats(cells: DataFrame, band: str, size: int, most_classes: int = 32) -> DataFrame:
    """Per tile counts, extremes, mean and deviation; if it has few distinct rounded values, the commonest non-zero one and its share."""
    t = cells.withColumns({"tile_r": F.floor(F.col("r") / size), "tile_c": F.floor(F.col("c") / size), "cls": F.bround(band).cast("long")})
    by = ["tile_r", "tile_c"]
    g = t.groupBy(*by).agg(F.count("*").alias("total"), F.count(band).alias("valid"), F.min(band).alias("min"), F.max(band).alias("max"), F.bround(F.avg(band), 6).alias("mean"), F.bround(F.stddev_pop(band), 6).alias("std"))
    n = t.filter("cls is not null").groupBy(*by, "cls").agg(F.count("*").alias("n"))
    top = n.groupBy(*by).agg(F.count("*").alias("classes"), F.max_by("cls", F.when(F.col("cls") != 0, F.struct("n", -F.col("cls")))).alias("dominant"), F.max(F.when(F.col("cls") != 0, F.col("n"))).alias("most"))
    few = F.col("classes") <= most_classes
    return g.join(top, by, "left").select(*by, "total", "valid", "min", "max", "mean", "std", "classes", F.when(few, F.col("dominant")).alias("dominant"), F.when(few, F.bround(F.col("most") * 100.0 / F.col("valid"), 2)).alias("dominant_pct"))


def band_profile(cells: DataFrame, band: str, most_classes: int = 30) -> DataFrame:
    """Extremes, mean, median, 2nd and 98th percentile, and whether the band is classified (whole numbers, few of them)."""
    v = F.col(band)
    g = cells.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.bround(F.avg(v), 6).alias("mean"), F.coalesce(F.bool_and(v == F.floor(v)), F.lit(False)).alias("whole"))
    # One value more than there may be classes is enough to know.
    few = cells.select(v.alias("v")).filter("v is not null").distinct().limit(most_classes + 1).agg(F.count("*").alias("kinds"))
    spread = quantiles(cells, {"p": (v, (0.5, 0.02, 0.98))}).select(*[F.col("p")[i].alias(n) for i, n in enumerate(("median", "p2", "p98"))])
    return g.crossJoin(spread).crossJoin(few).select("min", "max", "mean", "median", "p2", "p98", (F.col("whole") & (F.col("kinds") <= most_classes)).alias("classified"))


def confusion(predictions: DataFrame) -> DataFrame:
    """(y_true, y_pred, n) of the pairs without negative labels."""
    return predictions.filter("y_true >= 0 and y_pred >= 0").groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def error_map(predictions: DataFrame, keys: Sequence[str] = ("r", "c")) -> DataFrame:
    """(keys, state): correct, wrong, or ignored where either label is negative or missing."""
    known = F.coalesce((F.col("y_true") >= 0) & (F.col("y_pred") >= 0), F.lit(False))
    return predictions.select(*keys, F.when(~known, "ignored").when(F.col("y_true") == F.col("y_pred"), "correct").otherwise("wrong").alias("state"))


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """One row: accuracy, majority baseline, macro precision, recall and F1, weighted F1; 4 decimals, 0 where undefined."""
    n = confusion(predictions)
    true = n.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hit"))
    pred = n.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    j = true.join(pred, "label", "full_outer").na.fill(0, ["support", "hit", "predicted"])
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    j = j.withColumns({"pr": zero(F.col("hit"), F.col("predicted")), "rc": zero(F.col("hit"), F.col("support"))}).withColumn("f1", zero(2 * F.col("pr") * F.col("rc"), F.col("pr") + F.col("rc")))
    total = F.sum("support")
    return j.agg(F.bround(F.sum("hit") / total, 4).alias("accuracy"), F.bround(F.max("support") / total, 4).alias("baseline"), F.bround(F.avg("pr"), 4).alias("precision"), F.bround(F.avg("rc"), 4).alias("recall"), F.bround(F.avg("f1"), 4).alias("f1"), F.bround(F.sum(F.col("f1") * F.col("support")) / total, 4).alias("f1_weighted"))


def transition_matrix(pairs: DataFrame, cell_m2: float) -> DataFrame:
    """(from_class, to_class, cells, hectares, percent)."""
    g = pairs.groupBy("from_class", "to_class").agg(F.count("*").alias("cells"))
    return g.withColumn("hectares", F.bround(F.col("cells") * cell_m2 / 10000, 3)).withColumn("percent", F.bround(F.col("cells") * 100.0 / F.sum("cells").over(W.partitionBy(F.lit(1))), 4))


def verdict_rollup(tiles: DataFrame, aborted: DataFrame | None = None) -> DataFrame:
    """Per image the final verdict and the percentage of tiles verified; tiles without a verdict are not verifiable."""
    v = tiles.withColumn("verdict", F.coalesce("verdict", F.lit("not_verifiable")))
    is_ = lambda *x: F.col("verdict").isin(*x)
    g = v.groupBy("image_id").agg(F.count("*").alias("tiles"), F.bool_or(is_("wrong")).alias("wrong"), F.bool_or(is_("unsure", "needs_review")).alias("review"), F.bool_and(is_("not_verifiable")).alias("none"), F.bool_or(is_("correct")).alias("correct"), F.bround(F.count_if(is_("correct", "wrong")) * 100.0 / F.count("*"), 1).alias("verified_pct"))
    verdict = F.when(F.col("wrong"), "not_valid").when(F.col("review"), "needs_review").when(F.col("none"), "not_verifiable").when(~F.col("correct"), "needs_review").otherwise("valid")
    if aborted is not None:
        g = g.join(aborted.select("image_id", F.lit(True).alias("aborted")), "image_id", "left")
        verdict = F.when(F.col("aborted"), "insufficient_data").otherwise(verdict)
    return g.select("image_id", "tiles", "verified_pct", verdict.alias("verdict"))


def verdict_consensus(tiles: DataFrame, second: DataFrame, most: int = 4) -> DataFrame:
    """The first `most` flagged tiles of each image judged again: a different second verdict means needs_review."""
    flagged = tiles.filter(F.col("verdict").isin("wrong", "unsure")).withColumn("k", F.row_number().over(W.partitionBy("image_id").orderBy("tile_id"))).filter(F.col("k") <= most)
    again = flagged.join(second.select("image_id", "tile_id", F.col("verdict").alias("second")), ["image_id", "tile_id"], "left")
    again = again.select("image_id", "tile_id", F.when(F.col("second").isNotNull() & (F.col("second") != F.col("verdict")), "needs_review").alias("changed"))
    return tiles.join(again, ["image_id", "tile_id"], "left").select("image_id", "tile_id", F.coalesce("changed", "verdict").alias("verdict"))


def confusion_normalized(predictions: DataFrame) -> DataFrame:
    """(y_true, y_pred, share) of each true class's rows."""
    n = confusion(predictions)
    return n.select("y_true", "y_pred", F.bround(F.col("n") / F.sum("n").over(W.partitionBy("y_true")), 6).alias("share"))


def balance_weights(labels: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): N / (classes * n)."""
    g = labels.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = W.partitionBy(F.lit(1))
    return g.withColumn("weight", F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n")))


def resampled(rows: DataFrame, label: str, how: str, by: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Classes brought to the largest (oversample, with repeats) or to the smallest (undersample), in a seeded order of the columns `by`
    (all that are not of a complex type by default), the same however the rows are dealt."""
    by = [n for n, k in rows.dtypes if not k.startswith(("array", "map", "struct", "variant"))] if by is None else list(by)
    n = rows.groupBy(label).agg(F.count("*").alias("__n"))
    goal = n.agg(F.max("__n").alias("__goal") if how == "oversample" else F.min("__n").alias("__goal"))
    sizes = n.crossJoin(F.broadcast(goal))
    j = shuffled(rows, [label], by, seed, "__k").join(sizes.withColumnRenamed(label, "__label"), F.col(label).eqNullSafe(F.col("__label"))).drop("__label")
    if how == "undersample":
        return j.filter("__k < __goal").drop("__n", "__goal", "__k")
    copies = F.floor(F.col("__goal") / F.col("__n")) + (F.col("__k") < F.col("__goal") % F.col("__n")).cast("int")
    return j.withColumn("__c", F.explode(F.sequence(F.lit(1), copies))).drop("__n", "__goal", "__k", "__c")
