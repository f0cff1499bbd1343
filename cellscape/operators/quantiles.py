"""Exact linear quantiles of large groups in bounded memory.

A built-in exact percentile keeps every distinct value of a group in one buffer.  Here a rank sketch of fixed size first brackets each
wanted rank, whatever the values are (one outlier does not widen a bracket); a second pass counts each value inside a bracket, and
all others by the gap between brackets that they lie in.  Sorted, those counts hold the wanted order statistics exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranks are sketched to one part in this; brackets reach two parts to both sides.
ACCURACY = 4096


def quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column | str, Sequence[float]]], by: Sequence[str] = ()) -> DataFrame:
    """(by, one array<double> for each name of `wanted`): linear quantiles of a column at some shares, missing values left out.

    Equal to percentile() for every group; null elements where a group has no value.
    """
    keys, names = list(by), list(wanted)
    values = df.select(*keys, *[(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"__v{i}") for i, (c, _) in enumerate(wanted.values())])
    ends = {i: [min(1.0, max(0.0, p + side / ACCURACY)) for p in shares for side in (-2, 2)] for i, (_, shares) in enumerate(wanted.values())}
    sketch = values.groupBy(*keys).agg(*[F.percentile_approx(f"__v{i}", F.array(*map(F.lit, e)), F.lit(ACCURACY)).alias(f"__e{i}") for i, e in ends.items()])
    beside = values.join(sketch, keys) if keys else values.crossJoin(F.broadcast(sketch))

    def placed(i: int) -> Column:
        v, e = F.col(f"__v{i}"), F.col(f"__e{i}")
        inside, gap = F.lit(False), F.lit(0)
        for k in range(0, len(ends[i]), 2):
            inside, gap = inside | v.between(e[k], e[k + 1]), gap + (v > e[k + 1]).cast("int")
        return F.struct(F.lit(i).alias("i"), v.alias("v"), F.when(inside, v).alias("exact"), F.when(~inside, gap).alias("gap"))

    each = beside.select(*keys, F.explode(F.array(*[placed(i) for i in ends])).alias("x")).select(*keys, "x.*")
    counts = each.groupBy(*keys, "i", "exact", "gap").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # Missing values count 0, so a group without values keeps a row.
    group = W.partitionBy(*keys, "i")
    upto = F.sum("n").over(group.orderBy("lo").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumns({"upto": upto, "total": F.sum("n").over(group)}).withColumn("before", F.col("upto") - F.col("n"))

    def statistic(i: int, rank: Column) -> Column:
        """The value of a rank from 0; a gap knows its ends only, and a wanted rank is never further inside."""
        value = F.when(rank == F.col("before"), F.col("lo")).when(rank == F.col("upto") - 1, F.col("hi")).when(F.col("exact").isNotNull(), F.col("exact"))
        return F.max(F.when((F.col("i") == i) & (rank >= F.col("before")) & (rank < F.col("upto")), F.coalesce(value, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))))

    aggs = []
    for i, (_, shares) in enumerate(wanted.values()):
        for k, p in enumerate(shares):
            at = (F.col("total") - 1) * F.lit(float(p))
            aggs += [statistic(i, F.floor(at)).alias(f"__a{i}_{k}"), statistic(i, F.ceil(at)).alias(f"__b{i}_{k}"), F.max(F.when(F.col("i") == i, at)).alias(f"__p{i}_{k}")]
    found = ranked.groupBy(*keys).agg(*aggs)

    def linear(i: int, k: int) -> Column:
        a, b, at = F.col(f"__a{i}_{k}"), F.col(f"__b{i}_{k}"), F.col(f"__p{i}_{k}")
        return F.when(a == b, a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b)

    return found.select(*keys, *[F.array(*[linear(i, k) for k in range(len(wanted[n][1]))]).alias(n) for i, n in enumerate(names)])


def with_quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column | str, Sequence[float]]], by: Sequence[str] = ()) -> DataFrame:
    """df with each group's quantiles beside every row."""
    found = quantiles(df, wanted, by)
    return df.join(found, list(by)) if by else df.crossJoin(F.broadcast(found))
