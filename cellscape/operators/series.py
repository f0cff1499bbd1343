"""Cell series: one row a cell and date, (cell, d, y); a missing y is NULL."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellscape.functions.special import normal_p, student_p
from cellscape.sources.scratch import stored

YEAR = 365.2425


def _by():
    return W.partitionBy("cell").orderBy("d")


def lag_features(series: DataFrame, lags: list[int]) -> DataFrame:
    """One column a lag: positive lags look back, negative ones ahead, by position."""
    return series.withColumns({f"lag_{k}" if k >= 0 else f"lead_{-k}": F.lag("y", k).over(_by()) for k in lags})


def fill_gaps(series: DataFrame, method: str = "linear", limit: int | None = None) -> DataFrame:
    """(cell, d, y, filled): linear in time (ends take the nearest valid value), nearest, forward or backward.

    With a limit, at most that many missing values in a row are filled after a valid one (for linear and nearest: also before one).
    """
    back, ahead = _by().rowsBetween(W.unboundedPreceding, 0), _by().rowsBetween(0, W.unboundedFollowing)
    valid = F.col("y").isNotNull()
    at = series.withColumn("n", F.row_number().over(_by()))
    for name, over, pick in (("a", back, F.last), ("b", ahead, F.first)):
        for out, col in (("y", F.col("y")), ("d", F.col("d")), ("n", F.col("n"))):
            at = at.withColumn(name + out, pick(F.when(valid, col), ignorenulls=True).over(over))
    from_a, from_b = F.datediff("d", "ad"), F.datediff("bd", "d")
    value = {
        "forward": F.col("ay"),
        "backward": F.col("by"),
        "nearest": F.when(F.col("by").isNull() | (from_a <= from_b), F.coalesce("ay", "by")).otherwise(F.col("by")),
        "linear": F.when(F.col("ay").isNull(), F.col("by")).when(F.col("by").isNull(), F.col("ay")).otherwise(F.col("ay") + (F.col("by") - F.col("ay")) * F.try_divide(from_a.cast("double"), (from_a + from_b).cast("double"))),
    }[method]
    if limit is not None:
        after, before = F.coalesce(F.col("n") - F.col("an") <= limit, F.lit(False)), F.coalesce(F.col("bn") - F.col("n") <= limit, F.lit(False))
        value = F.when({"forward": after, "backward": before}.get(method, after | before), value)
    return at.select("cell", "d", F.coalesce("y", value).alias("y"), (~valid & value.isNotNull()).alias("filled"))


def _days(series: DataFrame) -> DataFrame:
    """x in years from the first date of the whole stack."""
    return series.crossJoin(F.broadcast(series.agg(F.min("d").alias("d0")))).withColumn("x", F.datediff("d", "d0") / F.lit(YEAR))


def ols_trend(series: DataFrame, p_values: bool = True) -> DataFrame:
    """Per cell with 3 values or more: slope per year, intercept, r, standard error and, on request, the two-sided p-value."""
    v = _days(series.filter("y is not null"))
    x, y = F.col("x"), F.col("y")
    g = v.groupBy("cell").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")).filter("n >= 3")
    r = F.when(F.col("syy") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))))).otherwise(0.0)
    g = g.withColumn("r", r).withColumn("se", F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx")))
    g = g.select("cell", "n", "slope", "intercept", "r", "se")
    return g.withColumn("p", student_p(F.try_divide("slope", "se"), (F.col("n") - 2).cast("double"))) if p_values else g


def trend_per_year(series: DataFrame) -> DataFrame:
    """Slope per year of 365.25 whole days."""
    first = series.filter("y is not null").withColumn("d0", F.min("d").over(W.partitionBy("cell")))
    return first.groupBy("cell").agg(F.count("*").alias("n"), F.regr_slope(F.col("y"), F.datediff("d", "d0") / F.lit(365.25)).alias("slope")).filter("n >= 3")


def anomaly_zscore(series: DataFrame) -> DataFrame:
    """(cell, z): how far the last value is from the earlier ones, in their population deviations."""
    v = series.filter("y is not null").withColumn("k", F.row_number().over(W.partitionBy("cell").orderBy(F.desc("d"))))
    early = F.when(F.col("k") > 1, F.col("y"))
    g = v.groupBy("cell").agg(F.max(F.when(F.col("k") == 1, F.col("y"))).alias("last"), F.avg(early).alias("mean"), F.stddev_pop(early).alias("std"), F.count("*").alias("n"))
    return g.filter("n >= 3").select("cell", F.try_divide(F.col("last") - F.col("mean"), F.col("std")).alias("z"))


def _sorted_series(series: DataFrame) -> DataFrame:
    """(cell, s, n): each cell's valid (d, y) in order of dates, and how many there are."""
    return series.filter("y is not null").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("d", "y"))).alias("s"), F.count("*").alias("n"))


def pair_order(v: np.ndarray, least: int = 64) -> tuple[int, int]:
    """(ascents, ties) among all pairs of an earlier and a later value: halves are sorted and counted against each other, so no pair is made."""
    n = len(v)
    if n <= least:
        later = np.triu(np.ones((n, n), bool), 1)
        return int(((v[None, :] > v[:, None]) & later).sum()), int(((v[None, :] == v[:, None]) & later).sum())
    half = n // 2
    left, right = np.sort(v[:half]), v[half:]
    below, upto = np.searchsorted(left, right, "left"), np.searchsorted(left, right, "right")
    (a, t), (c, u) = pair_order(v[:half], least), pair_order(right, least)
    return a + c + int(below.sum()), t + u + int((upto - below).sum())


def _key(x: float) -> int:
    """An integer for a double, in the order of doubles."""
    bits = int(np.float64(x).view(np.int64))
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def _of_key(k: int) -> float:
    return float(np.int64(k).view(np.float64)) if k >= 0 else -float(np.int64(-k).view(np.float64))


def middle_slope(x: np.ndarray, y: np.ndarray, most: int = 512) -> float | None:
    """The median slope of all pairs of different x, for points in order of x and y; None for fewer than 3 such pairs.

    Long series: slopes up to a trial slope m are the pairs in which y - m * x does not rise, so a rank is found by halving between the
    extremes and counting, with no array of slopes.
    """
    n = len(x)
    if n <= most:
        i, j = np.triu_indices(n, 1)
        ok = x[j] > x[i]
        slopes = (y[j][ok] - y[i][ok]) / (x[j][ok] - x[i][ok])
        return float(np.median(slopes)) if len(slopes) >= 3 else None
    pairs = n * (n - 1) // 2
    _, sizes = np.unique(x, return_counts=True)
    _, equal = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    same_x, same = int((sizes * (sizes - 1) // 2).sum()), int((equal * (equal - 1) // 2).sum())
    m = pairs - same_x
    if m < 3:
        return None
    steep = float(y.max() - y.min()) / float(np.diff(np.unique(x)).min())

    def smallest(rank: int) -> float:
        lo, hi = _key(-steep), _key(steep)
        while lo < hi:
            mid = (lo + hi) // 2
            if pairs - pair_order(y - _of_key(mid) * x)[0] - same >= rank:
                hi = mid
            else:
                lo = mid + 1
        return _of_key(lo)

    a = smallest((m + 1) // 2)
    return a if m % 2 else (a + smallest(m // 2 + 1)) / 2


def _per_cell(series: DataFrame, run, out: str) -> DataFrame:
    """(cell, n, out) with out = run(days from the cell's first date, values) of each cell's valid rows, a cell a row."""
    rows = _sorted_series(series).select("cell", F.transform("s", lambda x: F.datediff(x["d"], F.col("s")[0]["d"])).alias("x"), F.transform("s", lambda x: x["y"].cast("double")).alias("y"), "n")
    kind = dict(rows.dtypes)["cell"]

    def each(batches):
        for b in batches:
            found = [run(np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64), np.asarray(y.values.to_numpy(zero_copy_only=False), np.float64)) for x, y in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(found, pa.float64())], names=["cell", "n", out])

    return rows.mapInArrow(each, f"cell {kind}, n long, {out} double")


def _kendall(x: np.ndarray, y: np.ndarray) -> float:
    rises, ties = pair_order(y)
    return float(2 * rises + ties - len(y) * (len(y) - 1) // 2)


def mann_kendall(series: DataFrame, alpha: float = 0.05, p_values: bool = True) -> DataFrame:
    """Per cell with 4 values or more: S, tau, z with continuity correction (no tie term) and, on request, p and significance."""
    g = _per_cell(series, _kendall, "s").filter("n >= 4").withColumn("m", F.col("n") * (F.col("n") - 1) / 2)
    var = F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18.0
    z = F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt(var)).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt(var)).otherwise(0.0)
    g = g.select("cell", "n", "s", (F.col("s") / F.col("m")).alias("tau"), z.alias("z"))
    return g.withColumn("p", normal_p("z")).withColumn("significant", F.col("p") < alpha) if p_values else g


def sens_slope(series: DataFrame) -> DataFrame:
    """Median of all pair slopes per year; 3 slopes at least."""
    found = _per_cell(series, lambda x, y: middle_slope(x / YEAR, y), "slope")
    return found.filter("slope is not null").select("cell", "slope")


def seasonal_baseline(series: DataFrame, period: str = "month", stat: str = "median") -> DataFrame:
    """(cell, d, y, base, anomaly): base over the cell's rows of the same month, quarter or day of year."""
    key = {"month": F.month("d"), "quarter": F.quarter("d"), "dayofyear": F.dayofyear("d")}[period]
    s = series.withColumn("season", key)
    base = s.groupBy("cell", "season").agg((F.median("y") if stat == "median" else F.avg("y")).alias("base"))
    return s.join(base, ["cell", "season"]).select("cell", "d", "y", "base", (F.col("y") - F.col("base")).alias("anomaly"))


def cusum(series: DataFrame, threshold: float = 3.0, slack: float = 0.5, min_size: int = 3) -> DataFrame:
    """(cell, changes, first): two-sided CUSUM of standardised values, set back on each hit; first is a position from 0, -1 if none."""
    g = series.filter("y is not null").groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "y"))), lambda x: x["y"]).alias("ys"), F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"))
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0).alias("n"), F.lit(-1).alias("first"), F.lit(1).alias("i"))

    def step(acc: Column, y: Column) -> Column:
        z = (y - F.col("m")) / F.col("sd")
        up, down = F.greatest(F.lit(0.0), acc["up"] + z - slack), F.greatest(F.lit(0.0), acc["down"] - z - slack)
        hit = (up > threshold) | (down > threshold)
        return F.struct(F.when(hit, 0.0).otherwise(up).alias("up"), F.when(hit, 0.0).otherwise(down).alias("down"), (acc["n"] + hit.cast("int")).alias("n"), F.when(hit & (acc["first"] < 0), acc["i"]).otherwise(acc["first"]).alias("first"), (acc["i"] + 1).alias("i"))

    walked = F.aggregate(F.slice("ys", F.lit(2), F.size("ys")), start, step)
    ok = (F.size("ys") >= 2 * min_size) & (F.col("sd") >= 1e-6)
    return g.select("cell", F.when(ok, walked).alias("w")).select("cell", F.coalesce("w.n", F.lit(0)).alias("changes"), F.coalesce("w.first", F.lit(-1)).alias("first"))


def middle_gap(y: np.ndarray) -> float:
    """The median of the squared differences of all pairs, without making them: differences up to a trial gap are counted in sorted order."""
    s = np.sort(y)
    n = len(s)
    m = n * (n - 1) // 2

    def smallest(rank: int) -> float:
        """The rank-th smallest difference (from 1): bisection over the bits of a double."""
        lo, hi = 0, int(np.float64(s[-1] - s[0]).view(np.int64))
        while lo < hi:
            mid = (lo + hi) // 2
            gap = np.int64(mid).view(np.float64)
            if int(np.searchsorted(s, s + gap, "right").sum()) - n * (n + 1) // 2 >= rank:
                hi = mid
            else:
                lo = mid + 1
        return float(np.int64(lo).view(np.float64))

    if m == 0:
        return 0.0
    a, b = smallest((m + 1) // 2), smallest(m // 2 + 1)
    return (a * a + b * b) / 2


class KernelCost:
    """Cost of a segment: its length less the mean similarity of its values, summed; similarity exp(-gap / median gap), gaps held to 0.01..100.

    Similarities are made a few rows at a time, so memory grows with the series and not with its square.
    """

    def __init__(self, y: np.ndarray):
        self.y, self.scale = y, middle_gap(y) or 1.0

    def alike(self, rows: slice, cols: slice) -> np.ndarray:
        """The similarities of some values with others, 1 of a value with itself."""
        gap = (self.y[rows, None] - self.y[None, cols]) ** 2 / self.scale
        out = np.exp(-np.clip(gap, 1e-2, 1e2))
        i = np.arange(max(rows.start, cols.start), min(rows.stop, cols.stop))
        out[i - rows.start, i - cols.start] = 1.0
        return out

    def prefixes(self, start: int, stop: int, rows: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Of each place b in start..stop: the similarities summed over [start, b) and over [b, stop)."""
        before, after = np.zeros(stop - start + 1), np.zeros(stop - start + 1)
        for a in range(start, stop, rows):
            b = min(stop, a + rows)
            part = self.alike(slice(a, b), slice(start, stop)).cumsum(axis=1)
            at = np.arange(a, b) - start
            upto = part[np.arange(b - a), at]
            before[at + 1] = 2 * upto - 1
            after[at] = 2 * (part[:, -1] - upto) + 1
        return before.cumsum(), after[::-1].cumsum()[::-1]

    @staticmethod
    def of(total: np.ndarray, length: np.ndarray) -> np.ndarray:
        return length - total / length


def pruned_cuts(y: np.ndarray, penalty: float, min_size: int, jump: int) -> list[int]:
    """Optimal cuts at multiples of `jump`: of each end the best last cut, among starts not yet beaten by more than the penalty."""
    n, cost = len(y), KernelCost(y)
    ends = [k for k in range(0, n, jump) if k >= min_size] + [n]
    best, last = {0: 0.0}, {}
    starts, sums, at = np.empty(0, np.int64), np.empty(0), 0
    for end in ends:
        # Similarities of the values that came in since the last end, with all since the earliest start.
        fresh = (end - min_size) // jump * jump
        if fresh not in starts:
            first = cost.prefixes(fresh, at)[0][-1] if fresh < at else 0.0
            starts, sums = np.append(starts, fresh), np.append(sums, first)
        for a in range(at, end, 128):
            b = min(end, a + 128)
            low = int(starts.min())
            part = cost.alike(slice(a, b), slice(low, b))
            # Sum over [start, b) x [a, b), counted on both sides, less the square that was counted twice.
            column = np.concatenate([[0.0], part.sum(axis=0).cumsum()])
            own = part[:, a - low :].sum()
            late = starts > a
            sums += np.where(late, 0.0, 2 * (column[-1] - column[np.minimum(starts, a) - low]) - own)
            for k in np.flatnonzero(late):
                inside = cost.alike(slice(int(starts[k]), b), slice(int(starts[k]), b)) if starts[k] < b else np.zeros((0, 0))
                sums[k] = inside.sum()
        at = end
        known = np.array([s in best for s in starts])
        score = np.full(len(starts), np.inf)
        score[known] = np.array([best[s] for s in starts[known]]) + KernelCost.of(sums[known], end - starts[known]) + penalty
        k = int(np.argmin(score))
        best[end], last[end] = float(score[k]), int(starts[k])
        keep = known & (score <= best[end] + penalty)
        starts, sums = starts[keep], sums[keep]
    cuts, b = [], n
    while (b := last[b]) > 0:
        cuts.append(b)
    return cuts[::-1]


def binary_cuts(y: np.ndarray, penalty: float, min_size: int, jump: int) -> list[int]:
    """Cuts by halving: the segment whose best cut, `jump` apart from its start on, gains most is cut while that is more than the penalty."""
    cost, n = KernelCost(y), len(y)

    def best_cut(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a, b, jump)
        at = at[(at - a >= min_size) & (b - at >= min_size)]
        if not len(at):
            return 0.0, -1
        before, after = cost.prefixes(a, b)
        gain = KernelCost.of(before[-1], b - a) - KernelCost.of(before[at - a], at - a) - KernelCost.of(after[at - a], b - at)
        k = len(at) - 1 - int(np.argmax(gain[::-1]))  # of equal gains the later cut
        return float(gain[k]), int(at[k])

    open_ = {(0, n): best_cut(0, n)}
    while True:
        (a, b), (gain, cut) = max(open_.items(), key=lambda x: x[1][0])
        if cut < 0 or gain <= penalty:
            return sorted(x[0] for x in open_ if x[0] > 0)
        del open_[(a, b)]
        open_[(a, cut)], open_[(cut, b)] = best_cut(a, cut), best_cut(cut, b)


def segments(series: DataFrame, penalty: float | None = None, min_size: int = 3, method: str = "pelt", jump: int = 5) -> DataFrame:
    """(cell, changes, first): segmentation with a Gaussian-kernel cost and a penalty a change (default 3 ln n).

    `pelt` finds the cheapest cuts with pruned candidates, `binseg` cuts the segment that gains most again and again; cuts stand at multiples of
    `jump` of the valid dates (of a segment's start, in binseg).  `first` is the first cut's place among all dates of the cell, -1 if none.
    """
    if method not in ("pelt", "binseg"):
        raise ValueError("method must be 'pelt' or 'binseg'")
    cut = pruned_cuts if method == "pelt" else binary_cuts

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("d")["y"].to_numpy(np.float64)
        valid = np.flatnonzero(np.isfinite(y))
        cuts = cut(y[valid], 3 * np.log(len(valid)) if penalty is None else penalty, min_size, jump) if len(valid) >= 2 * min_size else []
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "changes": [len(cuts)], "first": [int(valid[cuts[0]]) if cuts else -1]})

    kind = dict(series.dtypes)["cell"]
    return series.groupBy("cell").applyInPandas(one, f"cell {kind}, changes int, first int")


#: Numbers that one step of a decomposition holds at once.
MOST_HELD = 1 << 20


def _loess(y: np.ndarray, width: int, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Local linear regression of each row of y over its positions 0, 1, ... with tricube weights of the `width` nearest, at the places `at`."""
    (m, n), out = y.shape, np.empty((len(y), len(at)))
    q = min(width, n)
    first = np.clip(np.ceil(at - q / 2), 0, n - q).astype(np.int64)
    step = max(1, MOST_HELD // (m * q))
    for k in range(0, len(at), step):
        x = at[k : k + step, None]
        near = first[k : k + step, None] + np.arange(q)
        far = np.abs(near - x)
        h = far.max(axis=1, keepdims=True) + max(0, width - n) // 2
        w = np.where(far <= 0.999 * h, (1 - (far / np.where(h > 0, h, 1.0)) ** 3) ** 3, 0.0)
        w = np.where(h > 0, w, 1.0)[None]
        values = np.take(y, near, axis=1)
        if weights is not None:
            w = w * np.take(weights, near, axis=1)
        total = w.sum(axis=2, keepdims=True)
        w = w / np.where(total > 0, total, 1.0)
        mean = (w * near).sum(axis=2, keepdims=True)
        var = (w * (near - mean) ** 2).sum(axis=2, keepdims=True)
        wide = np.sqrt(var) > 0.001 * max(n - 1, 1)
        w = w * np.where(wide, 1 + (x - mean) * (near - mean) / np.where(wide, var, 1.0), 1.0)
        out[:, k : k + step] = np.where(total[..., 0] > 0, (w * values).sum(axis=2), values.mean(axis=2))
    return out


def _moving(y: np.ndarray, width: int) -> np.ndarray:
    return np.stack([np.convolve(v, np.full(width, 1 / width), "valid") for v in y])


def _decomposed(y: np.ndarray, period: int, seasonal_width: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal part of a series, or of each row of y by the STL procedure: each phase's sub-series smoothed and prolonged by one cycle, its low-pass
    part taken off, the rest smoothed; `rounds` times anew with weights against outliers, for rows that have deviations."""
    if y.ndim == 1:
        trend, seasonal = _decomposed(y[None], period, seasonal_width, rounds)
        return trend[0], seasonal[0]
    (m, n), odd = y.shape, lambda v: int(np.ceil(v)) | 1
    period = min(period, n // 2)
    places = np.arange(n, dtype=float)
    if period < 2:
        return _loess(y, odd(1.5 * n), places), np.zeros((m, n))
    trend_width, low_width = odd(1.5 * period / (1 - 1.5 / seasonal_width) + 1e-9), odd(period + 1)
    trend, seasonal, weights, going = np.zeros((m, n)), np.zeros((m, n)), np.ones((m, n)), np.arange(m)
    for last in range(rounds + 1):
        values, t, w = y[going], trend[going], weights[going]
        for _ in range(2):
            free, cycles = values - t, np.empty((len(going), n + 2 * period))
            for k in range(period):
                sub = free[:, k::period]
                cycles[:, k::period][:, : sub.shape[1] + 2] = _loess(sub, seasonal_width, np.arange(-1.0, sub.shape[1] + 1), w[:, k::period])
            low = _loess(_moving(_moving(_moving(cycles, period), period), 3), low_width, places)
            s = cycles[:, period : period + n] - low
            t = _loess(values - s, trend_width, places, w)
        trend[going], seasonal[going] = t, s
        off = np.abs(values - t - s)
        h = 6 * np.median(off, axis=1, keepdims=True)
        still = h[:, 0] > 0
        if last == rounds or not still.any():
            break
        going, off, h = going[still], off[still], h[still]
        weights[going] = np.where(off <= 0.001 * h, 1.0, np.where(off <= 0.999 * h, (1 - np.minimum(off / h, 1) ** 2) ** 2, 0.0))
    return trend, seasonal


def _interpolated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """y with missing values interpolated in x, its ends at the nearest valid value; 0 where there is none."""
    valid = ~np.isnan(y)
    return y if valid.all() else np.interp(x, x[valid], y[valid]) if valid.any() else np.zeros(len(y))


def stl(series: DataFrame, period: int = 12, robust: bool = True, seasonal_width: int = 7) -> DataFrame:
    """(cell, d, observed, trend, seasonal, resid): seasonal-trend decomposition by local regression; missing values interpolated in time.

    Cells with equally many dates are decomposed side by side, as many as MOST_HELD allows.
    """
    rows = series.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("d", F.col("y").cast("double").alias("y")))).alias("s"))
    rows = rows.select("cell", F.transform("s", lambda v: v["d"]).alias("d"), F.transform("s", lambda v: v["y"]).alias("y"))

    def each(batches):
        for b in batches:
            cells, days, ys = b.column(0), b.column(1), b.column(2)
            sizes = ys.value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                same = np.flatnonzero(sizes == n)
                step = max(1, MOST_HELD // (64 * int(n)))
                for k in range(0, len(same), step):
                    at = pa.array(same[k : k + step])
                    d = days.take(at).flatten()
                    x = d.cast(pa.int32()).to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.float64)
                    raw = ys.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.float64)
                    y = np.stack([_interpolated(*v) for v in zip(x, raw)])
                    trend, seasonal = _decomposed(y, period, seasonal_width, 15 if robust else 0)
                    named = cells.take(pa.array(np.repeat(same[k : k + step], n))).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([named, d, *[pa.array(v.ravel()) for v in (y, trend, seasonal, y - trend - seasonal)]], names=["cell", "d", "observed", "trend", "seasonal", "resid"])

    return rows.mapInArrow(each, "cell long, d date, observed double, trend double, seasonal double, resid double")


def forecast(series: DataFrame, steps: int = 3, method: str = "linear") -> DataFrame:
    """(cell, step, d, y) at the mean spacing after the last date: by regression on days, the mean, or the drift between the ends."""
    v = series.filter("y is not null").crossJoin(F.broadcast(series.agg(F.min("d").alias("d0")))).withColumn("x", F.datediff("d", "d0").cast("double"))
    g = v.groupBy("cell").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.first("d0").alias("d0"), F.regr_slope(F.col("y"), F.col("x")).alias("b"), F.regr_intercept(F.col("y"), F.col("x")).alias("a"), F.avg("y").alias("m"), F.min_by("y", "x").alias("y0"), F.max_by("y", "x").alias("y1")).filter("n >= 2")
    g = g.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("gap", (F.col("x1") - F.col("x0")) / (F.col("n") - 1))
    x = F.col("x1") + F.col("step") * F.col("gap")
    y = {"linear": F.col("a") + F.col("b") * x, "mean": F.col("m"), "drift": F.col("y1") + F.col("step") * F.col("gap") * F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))}[method]
    return g.select("cell", "step", F.date_add("d0", F.floor(x).cast("int")).alias("d"), y.alias("y"))


def cluster_series(series: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """(cell, cluster) by k-means on the complete trajectories; cells with gaps, or all if fewer than k are complete, get -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    g = series.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "y"))), lambda x: x["y"]).alias("ys"), F.count("y").alias("valid"), F.count("*").alias("n"))
    full = stored(g.filter("valid = n").select("cell", "ys")).select("cell", array_to_vector("ys").alias("features"))
    if full.limit(k).count() < k:
        return g.select("cell", F.lit(-1).alias("cluster"))
    found = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(full).transform(full)
    return g.select("cell").join(found.select("cell", "cluster"), "cell", "left").na.fill(-1, ["cluster"])


def with_trend(series: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(cell, d, y, trend, change): each value beside its cell's fitted trend; `change` marks the position that `changes` (cell, first) names,
    as cusum and segments return it."""
    v = _days(series.filter("y is not null"))
    fitted = ols_trend(series, p_values=False).select("cell", "slope", "intercept")
    out = v.join(fitted, "cell").withColumn("trend", F.col("intercept") + F.col("slope") * F.col("x"))
    mark = F.lit(False)
    if changes is not None:
        out = out.join(changes.select("cell", "first"), "cell", "left")
        mark = F.coalesce(F.row_number().over(_by()) - 1 == F.col("first"), F.lit(False))
    return out.withColumn("change", mark).select("cell", "d", "y", "trend", "change")
