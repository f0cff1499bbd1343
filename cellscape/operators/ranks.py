"""Prefix sums and ranks of large groups in two levels: no task gets more than a part of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix_sums(df: DataFrame, keys: list[str], part: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of `value` over the earlier rows of the same keys, in the order (part, order), as column `out`.

    Two levels: sums of each part, prefix sums of those, and a running sum inside a part.  No task gets
    more than one part of a key, however large the key is.
    """
    sums = df.groupBy(*keys, part).agg(F.sum(value).alias("__sum"))
    over = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(over), F.lit(0))).drop("__sum")
    inside = W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    cond = F.lit(True)
    for k in [*keys, part]:
        cond = cond & rows[k].eqNullSafe(sums[k])
    joined = rows.join(sums, cond)
    for k in [*keys, part]:
        joined = joined.drop(sums[k])
    return joined.withColumn(out, F.col("__inside") + F.col("__before")).drop("__inside", "__before")


def ranked(df: DataFrame, keys: list[str], part: Column, order: list[Column], out: str) -> DataFrame:
    """df with each row's rank from 0 among the rows of its keys, in the order (part, order)."""
    rows = df.withColumns({"__part": part, "__one": F.lit(1)})
    return prefix_sums(rows, keys, "__part", order, "__one", out).drop("__part", "__one")


def shuffled(df: DataFrame, keys: list[str], by: list[str], seed: int, out: str) -> DataFrame:
    """df with each row's rank from 0 among the rows of its keys, in the order of a hash of the seed and the columns `by`.

    The order does not depend on how the rows are dealt; rows that are equal in `by` stand next to each other.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    rows = df.withColumn("__key", F.md5(text))
    return ranked(rows, keys, F.substring("__key", 1, 3), [F.col("__key")], out).drop("__key")
