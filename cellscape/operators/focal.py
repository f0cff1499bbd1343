"""Neighbourhood operators on dense grids: windows along rows, then along columns.

Each is two shuffles, by (raster, row) and by (raster, column); a task holds grid lines, never a whole raster.
Edges: `replicate` repeats the edge cell, `mirror` reflects including it, `wrap` continues on the other side.
`by` names the raster keys; a grid has one row for every cell of its rectangle, no-data cells NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellscape.operators.cells import with_scalars
from cellscape.operators.quantiles import with_quantiles


def infilled(cells: DataFrame, value: str, how: str, by: Sequence[str] = ()) -> DataFrame:
    """Column v: the value, with missing cells at the raster's median, mean or minimum."""
    if how == "median":
        filled = with_quantiles(cells, {"__fill": (value, (0.5,))}, by).withColumn("__fill", F.col("__fill")[0])
    else:
        filled = with_scalars(cells, by, {"mean": F.avg(value), "min": F.min(value)}[how].alias("__fill"))
    return filled.withColumn("v", F.coalesce(F.col(value), F.col("__fill"))).drop("__fill")


def extents(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_scalars(cells, by, F.min("r").alias("__r0"), F.max("r").alias("__r1"), F.min("c").alias("__c0"), F.max("c").alias("__c1"))


def lines(axis: str, by: Sequence[str] = ()):
    """The window along rows (axis c) or along columns (axis r)."""
    return W.partitionBy(*by, "r" if axis == "c" else "c").orderBy(axis)


def sides(x: str, axis: str, by: Sequence[str] = (), edge: str = "replicate") -> tuple[Column, Column]:
    """The values one step before and after along an axis; mirror equals replicate at this width."""
    over = lines(axis, by)
    whole = over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at, last = F.row_number().over(over), F.count("*").over(whole)
    if edge == "wrap":
        return F.when(at == 1, F.last(x).over(whole)).otherwise(F.lag(x).over(over)), F.when(at == last, F.first(x).over(whole)).otherwise(F.lead(x).over(over))
    return F.when(at == 1, F.col(x)).otherwise(F.lag(x).over(over)), F.when(at == last, F.col(x)).otherwise(F.lead(x).over(over))


def gather3(cells: DataFrame, value: str, by: Sequence[str] = (), edge: str = "replicate") -> DataFrame:
    """Column n9: the 3x3 neighbourhood of value, row by row, the cell itself at index 4."""
    a, b = sides(value, "c", by, edge)
    row = cells.withColumn("__row", F.struct(a.alias("w"), F.col(value).alias("m"), b.alias("e")))
    up, down = sides("__row", "r", by, edge)
    return row.withColumn("__up", up).withColumn("__down", down).withColumn("n9", F.array(*[F.col(f"{k}.{p}") for k in ("__up", "__row", "__down") for p in ("w", "m", "e")])).drop("__row", "__up", "__down")


def horn(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns gx and gy: Sobel sums of v (east minus west, south minus north), separable."""
    w, e = sides("v", "c", by)
    rows = cells.withColumn("__d", e - w).withColumn("__s", w + 2 * F.col("v") + e)
    dn, ds = sides("__d", "r", by)
    sn, ss = sides("__s", "r", by)
    return rows.withColumn("gx", dn + 2 * F.col("__d") + ds).withColumn("gy", ss - sn).drop("__d", "__s")


def gradient(cells: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(…, value): Sobel magnitude with missing cells at the mean; missing cells stay missing."""
    g = horn(infilled(cells, value, "mean", by), by)
    return g.select(*by, "r", "c", F.when(F.col(value).isNotNull(), F.hypot("gx", "gy")).alias("value"))


def slope(cells: DataFrame, value: str, dx: float, dy: float, degrees: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """(…, value, dzdx, dzdy) by Horn's formula; missing cells at the median, and missing in the result."""
    g = horn(infilled(cells, value, "median", by), by).withColumn("dzdx", F.col("gx") / (8.0 * dx)).withColumn("dzdy", F.col("gy") / (8.0 * dy))
    rise = F.hypot("dzdx", "dzdy")
    return g.select(*by, "r", "c", F.when(F.col(value).isNotNull(), F.degrees(F.atan(rise)) if degrees else rise * 100.0).alias("value"), "dzdx", "dzdy")


def aspect(cells: DataFrame, value: str, dx: float, dy: float, flat: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(…, value): (180 - degrees(atan2(dz/dy, -dz/dx))) mod 360, -1 where the slope is below `flat` degrees."""
    s = slope(cells, value, dx, dy, True, by)
    angle = F.pmod(180.0 - F.degrees(F.atan2(F.col("dzdy"), -F.col("dzdx"))), F.lit(360.0))
    return s.select(*by, "r", "c", F.when(F.col("value").isNull(), None).when(F.col("value") < flat, -1.0).otherwise(angle).alias("value"))


def hillshade(cells: DataFrame, value: str, dx: float, dy: float, azimuths=(315.0, 225.0, 45.0, 135.0), weights=(0.40, 0.25, 0.25, 0.10), altitude: float = 45.0, z_factor: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """(…, value): weighted light from several azimuths, whole numbers 0..255; missing cells 0."""
    import math

    # Only valid cells are scaled; gaps take the unscaled median.
    filled = infilled(cells, value, "median", by)
    g = horn(filled.withColumn("v", F.when(F.col(value).isNotNull(), F.col(value) * z_factor).otherwise(F.col("v"))), by)
    p, q = F.col("gx") / (8.0 * dx), F.col("gy") / (8.0 * dy)
    steep, turn = F.atan(F.hypot(p, q)), F.atan2(q, -p)
    zenith, light = math.radians(90.0 - altitude), F.lit(0.0)
    for azimuth, weight in zip(azimuths, weights):
        toward = math.radians((360.0 - azimuth + 90.0) % 360.0)
        light = light + weight * F.greatest(F.lit(0.0), math.cos(zenith) * F.cos(steep) + math.sin(zenith) * F.sin(steep) * F.cos(toward - turn))
    shade = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), light * 255.0))).cast("int")
    return g.select(*by, "r", "c", F.when(F.col(value).isNotNull(), shade).otherwise(0).alias("value"))


def ruggedness(cells: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(…, value): root mean square difference to the 8 neighbours; missing if any of the nine is."""
    g = gather3(cells, value, by)
    total = F.aggregate("n9", F.lit(0.0), lambda acc, x: acc + (x - F.col(value)) * (x - F.col(value)))
    return g.select(*by, "r", "c", F.sqrt(total / 8.0).alias("value"))


def padded(cells: DataFrame, axis: str, reach: int, edge: str, lo: str, hi: str) -> DataFrame:
    """Lines made longer by `reach` cells on both sides along an axis: edge cells are repeated at their halo places."""
    x, first, last = F.col(axis), F.col(lo), F.col(hi)
    n = last - first + 1
    places = [F.array(x)]
    if edge == "replicate":
        ahead = F.sequence(F.lit(1), F.lit(reach))
        places += [F.when(x == first, F.transform(ahead, lambda k: first - k)).otherwise(F.array().cast("array<bigint>")), F.when(x == last, F.transform(ahead, lambda k: last + k)).otherwise(F.array().cast("array<bigint>"))]
    elif edge == "mirror":
        places += [F.array(2 * first - 1 - x), F.array(2 * last + 1 - x)]
    else:
        places += [F.array(x - n), F.array(x + n)]
    at = F.filter(F.array_distinct(F.concat(*places)), lambda p: (p >= first - reach) & (p <= last + reach))
    return cells.withColumn(axis, F.explode(at))


def box_sums(cells: DataFrame, columns: Sequence[str], size: int, edge: str, by: Sequence[str] = ()) -> DataFrame:
    """Sums of columns over size x size boxes, in columns sum_<name>; the other columns are those of the centre."""
    reach = size // 2
    known = "__r0" in cells.columns  # extents() was called before: one scan of the raster serves several boxes
    out = cells if known else extents(cells, by)
    for axis, lo, hi, before in (("c", "__c0", "__c1", ""), ("r", "__r0", "__r1", "sum_")):
        wide = padded(out, axis, reach, edge, lo, hi)
        over = lines(axis, by).rowsBetween(-reach, reach)
        wide = wide.withColumns({f"sum_{n}": F.sum(f"{before}{n}").over(over) for n in columns})
        out = wide.filter((F.col(axis) >= F.col(lo)) & (F.col(axis) <= F.col(hi)))
    return out if known else without_extents(out)


def without_extents(cells: DataFrame) -> DataFrame:
    return cells.drop("__r0", "__r1", "__c0", "__c1")


def position_index(cells: DataFrame, value: str, size: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(…, value): the value minus the box mean, missing cells at the median, replicated edge."""
    g = box_sums(infilled(cells, value, "median", by), ["v"], size, "replicate", by)
    return g.select(*by, "r", "c", F.when(F.col(value).isNotNull(), F.col("v") - F.col("sum_v") / (size * size)).alias("value"))


def speckle_filter(cells: DataFrame, value: str, size: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(…, value): box mean over the valid cells, mirrored edge; missing cells stay missing."""
    g = cells.withColumns({"v": F.coalesce(F.col(value), F.lit(0.0)), "k": F.col(value).isNotNull().cast("double")})
    g = box_sums(g, ["v", "k"], size, "mirror", by)
    return g.select(*by, "r", "c", F.when(F.col(value).isNotNull(), F.col("sum_v") / F.col("sum_k")).alias("value"))


def texture(cells: DataFrame, value: str, size: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(…, value): local standard deviation, sqrt(max(0, mean of squares - square of mean)), mirrored edge."""
    g = box_sums(cells.withColumns({"v": F.col(value), "v2": F.col(value) * F.col(value)}), ["v", "v2"], size, "mirror", by)
    n = float(size * size)
    return g.select(*by, "r", "c", F.sqrt(F.greatest(F.lit(0.0), F.col("sum_v2") / n - (F.col("sum_v") / n) * (F.col("sum_v") / n))).alias("value"))


def median3(cells: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(…, value): 3x3 median, mirrored edge, of valid values."""
    g = gather3(cells, value, by)
    valid = F.array_sort(F.array_compact("n9"))
    n = F.size(valid)
    return g.select(*by, "r", "c", F.when(n > 0, F.element_at(valid, (F.floor(n / 2) + 1).cast("int"))).alias("value"))


def lbp(cells: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(…, value): how many of the 8 neighbours, wrapped around, are at most the centre."""
    g = gather3(cells, value, by, "wrap")
    around = F.concat(F.slice("n9", 1, 4), F.slice("n9", 6, 4))
    return g.select(*by, "r", "c", F.size(F.filter(around, lambda x: x <= F.col(value))).alias("value"))


def overview(cells: DataFrame, value: str, rows: int, cols: int, most: int = 256, by: Sequence[str] = ()) -> DataFrame:
    """(…, r, c, z): area means on a grid of at most `most` cells a side, 1 decimal; values below -1000 are no data, gaps take the minimum."""
    h, w = max(1, min(most, rows)), max(1, min(most, cols))
    got = cells.groupBy(*by, F.floor(F.col("r") * h / F.lit(rows)).alias("r"), F.floor(F.col("c") * w / F.lit(cols)).alias("c")).agg(F.avg(F.when(F.col(value) > -1000, F.col(value))).alias("z"))
    low = with_scalars(got, by, F.min("z").alias("__low"))
    return low.select(*by, "r", "c", F.bround(F.coalesce("z", "__low"), 1).alias("z"))
