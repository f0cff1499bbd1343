"""Two dates compared, and classes by rules on indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.functions.indices import index
from cellscape.functions.sar import to_db
from cellscape.operators.cells import cloud_flag, compute_index
from cellscape.operators.grids import Scene, change_guard


def difference(before: DataFrame, after: DataFrame, column: str = "value", keys: Sequence[str] = ("r", "c")) -> DataFrame:
    """(keys, before, after, diff): after - before, cell by cell."""
    a = before.select(*keys, F.col(column).alias("before"))
    return a.join(after.select(*keys, F.col(column).alias("after")), list(keys)).withColumn("diff", F.col("after") - F.col("before"))


def index_difference(before: Scene, after: Scene, name: str = "ndvi", **calibration) -> DataFrame:
    """(r, c, before, after, diff) of an index on two dates; refuses what change_guard refuses."""
    change_guard(before, after)
    return difference(compute_index(before.cells, name, **calibration), compute_index(after.cells, name, **calibration))


def db_change(before: DataFrame, after: DataFrame, column: str = "value") -> DataFrame:
    """(r, c, before, after, diff) in dB of linear backscatter."""
    return difference(before.select("r", "c", to_db(F.col(column)).alias(column)), after.select("r", "c", to_db(F.col(column)).alias(column)), column)


def flood_candidates(before_db: DataFrame, after_db: DataFrame, column: str = "value", drop_db: float = 3.0, most_after_db: float = -15.0) -> DataFrame:
    """(r, c) of cells that fell by drop_db at least, to most_after_db at most."""
    d = difference(before_db, after_db, column)
    return d.filter((F.col("before") - F.col("after") >= drop_db) & (F.col("after") <= most_after_db)).select("r", "c")


def index_stack(scenes: Sequence[DataFrame], name: str = "ndvi") -> DataFrame:
    """(t, r, c, value): an index of reflectance tables, numbered in the order given."""
    out = None
    for t, cells in enumerate(scenes):
        one = cells.select(F.lit(t).alias("t"), "r", "c", index(name).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def stack_bands(layers: Sequence[tuple[DataFrame, str]], keys: Sequence[str] = ("r", "c")) -> DataFrame:
    """(keys, features): bands of several tables as one array, for cells where all have a value."""
    out = None
    for k, (cells, band) in enumerate(layers):
        one = cells.select(*keys, F.col(band).cast("double").alias(f"_{k}")).filter(F.col(f"_{k}").isNotNull())
        out = one if out is None else out.join(one, list(keys))
    return out.select(*keys, F.array(*[f"_{k}" for k in range(len(layers))]).alias("features"))


def mutual_valid(layers: Sequence[tuple[DataFrame, str, str]], least: float = 0.15) -> DataFrame:
    """One row (n, valid, fraction, sufficient): cells with data and without cloud in every layer (cells, band, cloud method)."""
    each = None
    for cells, band, method in layers:
        one = cells.select("r", "c", (F.col(band).isNotNull() & ~cloud_flag(method)).alias("ok"))
        each = one if each is None else each.unionByName(one)
    g = each.groupBy("r", "c").agg(F.bool_and("ok").alias("ok")).agg(F.count("*").alias("n"), F.count_if("ok").alias("valid"))
    share = F.try_divide(F.col("valid").cast("double"), F.col("n"))
    return g.select("n", "valid", F.bround(share, 4).alias("fraction"), F.coalesce(share >= least, F.lit(False)).alias("sufficient"))


def terrestrial(cells: DataFrame) -> DataFrame:
    """The cells that are land: no gap, shadow, cloud or water by scene class, and no water by MNDWI or NDWI."""
    wet = F.coalesce(index("mndwi") > 0, F.lit(False)) | F.coalesce(index("ndwi") > 0.1, F.lit(False))
    return cells.filter(~F.col("scl").isin(0, 1, 3, 6, 8, 9, 10, 11) & ~wet)


def rule_landcover(cells: DataFrame, water: float = 0.1, plants: float = 0.2, moist: float = 0.0, built: float = 0.0, bare: float = 0.0) -> DataFrame:
    """(r, c, cls): 4 water, 1 vegetation, 2 built-up, 3 bare ground, 0 other; the first rule that holds."""
    rules = [(index("mndwi") > water, 4), ((index("msavi2") > plants) & (index("ndmi") > moist), 1), (index("ui") > built, 2), (index("bsi") > bare, 3)]
    cls = F.lit(0)
    for rule, k in reversed(rules):
        cls = F.when(rule, k).otherwise(cls)
    return cells.select("r", "c", cls.alias("cls"))
