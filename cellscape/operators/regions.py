"""Regions of a mask, distances to it, and flow over an elevation grid.

Masks are tables of selected cells (r, c).  Loops end when an aggregate shows no change and write each round to the shared folder.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellscape.operators.focal import slope
from cellscape.operators.graph import components
from cellscape.operators.ranks import ranked
from cellscape.sources.scratch import stored

#: Neighbours in the order that breaks ties.
NEAR = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def runs(mask: DataFrame) -> DataFrame:
    """(r, c0, c1, node): maximal runs of selected cells in each row; node orders runs by their first cell."""
    g = mask.select("r", "c").distinct().withColumn("g", F.col("c") - F.row_number().over(W.partitionBy("r").orderBy("c")))
    return g.groupBy("r", "g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).select("r", "c0", "c1", (F.shiftleft(F.col("r"), 32) + F.col("c0")).alias("node"))


def label_regions(mask: DataFrame, cell: int = 64) -> DataFrame:
    """(r, c, label): 4-connected regions, numbered from 1 in the scan order of their first cells."""
    found = stored(runs(mask))
    wide = found.withColumn("k", F.explode(F.sequence(F.floor(F.col("c0") / cell), F.floor(F.col("c1") / cell))))
    a = wide.select(F.col("r"), "k", F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("node").alias("a"))
    b = wide.select((F.col("r") - 1).alias("r"), "k", F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.col("node").alias("b"))
    links = a.join(b, ["r", "k"]).filter("a0 <= b1 and b0 <= a1").select("a", "b")
    joined = found.join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = ranked(joined.select("comp").distinct(), [], F.shiftright("comp", 40), [F.col("comp")], "label").withColumn("label", (F.col("label") + 1).cast("int"))
    return joined.join(names, "comp").select("r", F.explode(F.sequence("c0", "c1")).alias("c"), "label")


def region_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def filter_small(labels: DataFrame, least: int) -> DataFrame:
    """The cells of regions with at least `least` cells."""
    return labels.join(region_sizes(labels).filter(F.col("size") >= least).select("label"), "label", "left_semi").select("r", "c", "label")


def region_summary(labels: DataFrame, top: int = 5) -> DataFrame:
    """(regions, largest, sizes): how many, the largest, and the `top` largest sizes."""
    s = region_sizes(labels)
    best = s.orderBy(F.desc("size"), "label").limit(top).agg(F.sort_array(F.collect_list("size"), asc=False).alias("sizes"))
    return s.agg(F.count("*").alias("regions"), F.coalesce(F.max("size"), F.lit(0)).alias("largest")).crossJoin(best)


def outline_edges(labels: DataFrame) -> DataFrame:
    """(label, x0, y0, x1, y1): sides of cells that border another region or nothing, the region on the left of the way."""
    cells = labels.select("r", "c", "label")
    sides = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), *[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), s)]) for dr, dc, s in (((-1), 0, (1, 0, 0, 0)), (1, 0, (0, 1, 1, 1)), (0, -1, (0, 0, 0, 1)), (0, 1, (1, 1, 1, 0)))])
    each = cells.withColumn("s", F.explode(sides)).select("label", (F.col("r") + F.col("s.dr")).alias("nr"), (F.col("c") + F.col("s.dc")).alias("nc"), *[(F.col("c" if n[0] == "x" else "r") + F.col(f"s.{n}")).alias(n) for n in ("x0", "y0", "x1", "y1")])
    other = cells.select(F.col("r").alias("nr"), F.col("c").alias("nc"), "label")
    return each.join(other, ["nr", "nc", "label"], "left_anti").select("label", "x0", "y0", "x1", "y1")


def _leaves(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether the way a, b, c turns away from the cell on its left."""
    return (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) > 0


def polygonize(labels: DataFrame, cell_m2: float, least: int = 1, most: int | None = None) -> DataFrame:
    """(label, area_ha, rings): outlines in cell units, the largest ring first; more than `most` regions, if given, are an error.

    A region's outline, not its cells, is chained in one task.  Where cells of a region touch at a corner only, the ring goes on along
    the other cell: what lies on its right is one connected piece, so no ring meets itself.
    """
    kept = filter_small(labels, least)
    sizes = region_sizes(kept)
    if most is not None and sizes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} regions")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        ways: dict[tuple, list[tuple]] = {}
        sides = [((x0, y0), (x1, y1)) for x0, y0, x1, y1 in pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False)]
        for a, b in sides:
            ways.setdefault(a, []).append(b)
        rings, left = [], set(sides)
        for first in sorted(sides):
            if first not in left:
                continue
            ring, side = [], first
            while side in left:
                left.remove(side)
                ring.append(side[0])
                a, b = side
                after = ways[b]
                side = (b, after[0] if len(after) == 1 else next(c for c in after if _leaves(a, b, c)))
            rings.append([[float(x), float(y)] for x, y in ring])
        rings.sort(key=lambda r: -abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))))
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "rings": [rings]})

    rings = outline_edges(kept).groupBy("label").applyInPandas(chain, "label int, rings array<array<array<double>>>")
    return sizes.join(rings, "label").select("label", F.bround(F.col("size") * cell_m2 / 10000, 3).alias("area_ha"), "rings")


def _lowest(x: np.ndarray, g2: np.ndarray) -> np.ndarray:
    """At each x the least of g2[i] + (x - x[i]) ** 2 over all i with a value, by the lower envelope of those parabolas."""
    order = np.argsort(x)
    held: list[int] = []
    bounds: list[float] = []
    for i in order[np.isfinite(g2[order])].tolist():
        while held:
            k = held[-1]
            cross = ((g2[i] + x[i] * x[i]) - (g2[k] + x[k] * x[k])) / (2 * (x[i] - x[k]))
            if not bounds or cross > bounds[-1]:
                break
            held.pop()
            bounds.pop()
        if held:
            bounds.append(cross)
        held.append(i)
    if not held:
        return np.full(len(x), np.nan)
    best = np.array(held)[np.searchsorted(np.array(bounds), x)]
    return g2[best] + (x - x[best]) ** 2


def distance_to_mask(grid: DataFrame, mask: DataFrame, dx: float, dy: float) -> DataFrame:
    """(r, c, value): exact Euclidean distance of every cell of the grid to the nearest selected one.

    Columns first (last and next selected row), then each row takes the minimum over its columns by a lower envelope, in time
    that grows with the row's width.
    """
    hit = grid.select("r", "c").join(mask.select("r", "c", F.lit(True).alias("m")).distinct(), ["r", "c"], "left")
    row = F.when(F.col("m"), F.col("r"))
    # From both ends: a frame up to the end of its partition would be read anew for each row.
    above, below = (F.last(row, ignorenulls=True).over(W.partitionBy("c").orderBy(order).rowsBetween(W.unboundedPreceding, 0)) for order in (F.asc("r"), F.desc("r")))
    g = hit.select("r", "c", (F.least(F.col("r") - above, below - F.col("r")) * F.lit(dy)).alias("g"))

    lines = g.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("held"))
    lines = lines.select("r", F.transform("held", lambda x: x["c"]).alias("c"), F.transform("held", lambda x: x["g"]).alias("g"))

    def each(batches):
        for b in batches:
            c, g2, ends = b.column(1).flatten(), b.column(2).flatten(), b.column(1).value_lengths().to_numpy().cumsum()
            x, y = c.to_numpy(zero_copy_only=False).astype(float) * dx, g2.to_numpy(zero_copy_only=False).astype(float) ** 2
            found = np.concatenate([_lowest(x[a:z], y[a:z]) for a, z in zip([0, *ends], ends)])
            values = pa.array(np.sqrt(found), mask=np.isnan(found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values)], names=["r", "c", "value"])

    # Many lines are one batch: a task does not begin anew for each.
    near = lines.mapInArrow(each, "r long, c array<long>, value array<double>")
    return near.select("r", F.explode(F.arrays_zip("c", "value")).alias("x")).select("r", "x.c", "x.value")


def fill_depressions(dem: DataFrame, value: str = "z", tile: int = 256, most_rounds: int | None = None) -> DataFrame:
    """(r, c, z, w, back): pits raised to their spill level; back numbers the neighbour (in NEAR) the flood came from, -1 at outlets.

    Outlets are cells on the border of the grid or beside a missing cell.  Tiles are flooded on their own with their
    neighbours' rims; a round floods the tiles beside which a level changed in the round before, until there are none.
    """
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in NEAR])
    cells = dem.filter(F.col(value).isNotNull()).select("r", "c", F.col(value).cast("double").alias("z"))
    around = cells.select(F.col("r").alias("sr"), F.col("c").alias("sc"), F.explode(near).alias("o")).groupBy((F.col("sr") + F.col("o.a")).alias("r"), (F.col("sc") + F.col("o.b")).alias("c")).agg(F.count("*").alias("k"))
    state = cells.join(around, ["r", "c"], "left").select("r", "c", "z", F.when(F.coalesce("k", F.lit(0)) < 8, F.col("z")).alias("w"), F.lit(-1).alias("back"))
    own = [F.floor(F.col(k) / tile).alias(t) for k, t in (("r", "tr"), ("c", "tc"))]
    state = stored(state.select("*", *own, F.lit(False).alias("changed")))
    active = stored(state.select("tr", "tc").distinct())

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        z = dict(zip(zip(pdf["r"], pdf["c"]), zip(pdf["z"], pdf["own"])))
        w = {(r, c): (v, b) for r, c, v, b in zip(pdf["r"], pdf["c"], pdf["w"], pdf["back"]) if v == v and v is not None}
        heap = sorted((v, k) for k, (v, _) in w.items())
        while heap:
            v, (r, c) = heapq.heappop(heap)
            if w[r, c][0] < v:
                continue
            for i, (a, b) in enumerate(NEAR):
                to = (r + a, c + b)
                if to in z and z[to][1] and (to not in w or w[to][0] > max(v, z[to][0])):
                    w[to] = (max(v, z[to][0]), 7 - i)
                    heapq.heappush(heap, (w[to][0], to))
        mine = pdf[pdf["own"]]
        at = list(zip(mine["r"], mine["c"]))
        level = np.array([w[k][0] if k in w else np.nan for k in at], float)
        changed = (level != mine["w"].to_numpy(float)) & ~(np.isnan(level) & np.isnan(mine["w"].to_numpy(float)))
        return pd.DataFrame({"r": mine["r"].to_numpy(), "c": mine["c"].to_numpy(), "z": mine["z"].to_numpy(), "w": level, "back": np.array([w[k][1] if k in w else -1 for k in at], np.int32), "tr": mine["tr"].to_numpy(), "tc": mine["tc"].to_numpy(), "changed": changed})

    rounds = 0
    while active.limit(1).count():
        if rounds == most_rounds:
            raise RuntimeError(f"levels did not settle in {most_rounds} rounds")
        rounds += 1
        # A cell also goes to the tiles that it touches.
        near_tiles = F.array_distinct(F.transform(F.concat(near, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))), lambda o: F.struct(F.floor((F.col("r") + o["a"]) / tile).alias("tr"), F.floor((F.col("c") + o["b"]) / tile).alias("tc"))))
        halo = state.withColumn("t", F.explode(near_tiles)).select("r", "c", "z", "w", "back", ((F.col("t.tr") == F.col("tr")) & (F.col("t.tc") == F.col("tc"))).alias("own"), F.col("t.tr").alias("tr"), F.col("t.tc").alias("tc"))
        flooded = halo.join(active, ["tr", "tc"], "left_semi").groupBy("tr", "tc").applyInPandas(flood, "r long, c long, z double, w double, back int, tr long, tc long, changed boolean")
        still = state.join(active, ["tr", "tc"], "left_anti").select("r", "c", "z", "w", "back", "tr", "tc", F.lit(False).alias("changed"))
        state = stored(flooded.withColumn("w", F.nanvl("w", F.lit(None).cast("double"))).unionByName(still))
        touched = state.filter("changed").select(F.col("tr").alias("or"), F.col("tc").alias("oc"), F.explode(near_tiles).alias("t")).select("or", "oc", "t.*").filter("or <> tr or oc <> tc")
        active = stored(touched.select("tr", "tc").distinct())
    return state.select("r", "c", "z", "w", "back")


def flow_direction(filled: DataFrame, dx: float, dy: float) -> DataFrame:
    """(r, c, w, to_r, to_c): steepest drop to one of 8 neighbours, the first of equals; flats follow the flood back to their outlet."""
    import math

    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(math.hypot(a * dy, b * dx)).alias("d")) for i, (a, b) in enumerate(NEAR)])
    each = filled.select("r", "c", "w", F.explode(near).alias("o")).withColumns({"nr": F.col("r") + F.col("o.a"), "nc": F.col("c") + F.col("o.b")})
    drop = each.join(filled.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("w").alias("nw")), ["nr", "nc"]).withColumn("drop", (F.col("w") - F.col("nw")) / F.col("o.d")).filter("drop > 0")
    best = drop.groupBy("r", "c").agg(F.max_by(F.struct("nr", "nc"), F.struct("drop", -F.col("o.i"))).alias("best"))
    back = F.get(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in NEAR]), F.when(F.col("back") >= 0, F.col("back")))
    j = filled.join(best, ["r", "c"], "left")
    return j.select("r", "c", "w", F.coalesce("best.nr", F.col("r") + back["a"]).alias("to_r"), F.coalesce("best.nc", F.col("c") + back["b"]).alias("to_c"))


class TileFlow:
    """The cells of one tile, the place inside the tile that each flows to (-1: out of it, or nowhere), and where that way leaves."""

    def __init__(self, r: np.ndarray, c: np.ndarray, to_r: np.ndarray, to_c: np.ndarray):
        n, width = len(r), int(c.max() - c.min()) + 1
        at = np.full((int(r.max() - r.min()) + 1) * width, -1, np.int64)
        at[(r - r.min()) * width + c - c.min()] = np.arange(n)
        inside = np.isfinite(to_r) & (to_r >= r.min()) & (to_r <= r.max()) & (to_c >= c.min()) & (to_c <= c.max())
        self.to = np.full(n, -1, np.int64)
        self.to[inside] = at[((to_r[inside] - r.min()) * width + to_c[inside] - c.min()).astype(np.int64)]

    def ends(self) -> np.ndarray:
        """The last cell inside the tile on each cell's way, by doubling the steps."""
        jump = np.where(self.to < 0, np.arange(len(self.to)), self.to)
        while (further := jump[jump]).tolist() != jump.tolist():
            jump = further
        return jump

    def gathered(self, weight: np.ndarray) -> np.ndarray:
        """Weights summed down the ways: cells whose inflow is complete hand theirs on, all of them at a time."""
        acc, open_ = weight.copy(), np.bincount(self.to[self.to >= 0], minlength=len(self.to))
        front = np.flatnonzero((open_ == 0) & (self.to >= 0))
        while len(front):
            to = self.to[front]
            np.add.at(acc, to, acc[front])
            np.subtract.at(open_, to, 1)
            to = np.unique(to)
            front = to[(open_[to] == 0) & (self.to[to] >= 0)]
        return acc


def _tile_flow(pdf: pd.DataFrame) -> TileFlow:
    return TileFlow(*(pdf[n].to_numpy(np.float64 if n.startswith("to_") else np.int64) for n in ("r", "c", "to_r", "to_c")))


def summed_down(nodes: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(r, c, acc) of a forest (r, c, pr, pc, acc): each node's acc and that of all below it.  Ways are doubled, so rounds are the logarithm of the longest."""
    state = stored(nodes.select("r", "c", "pr", "pc", "acc"))
    for _ in range(most_rounds):
        if not state.filter("pr is not null").limit(1).count():
            return state.select("r", "c", "acc")
        more = state.filter("pr is not null").groupBy(F.col("pr").alias("r"), F.col("pc").alias("c")).agg(F.sum("acc").alias("more"))
        jump = state.select(F.col("r").alias("pr"), F.col("c").alias("pc"), F.col("pr").alias("qr"), F.col("pc").alias("qc"))
        state = stored(state.join(more, ["r", "c"], "left").join(jump, ["pr", "pc"], "left").select("r", "c", F.col("qr").alias("pr"), F.col("qc").alias("pc"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")))
    raise RuntimeError(f"flow did not settle in {most_rounds} rounds")


def flow_accumulation(flow: DataFrame, tile: int = 256) -> DataFrame:
    """(r, c, acc): cells that drain through each cell, itself included.

    Two passes over the grid, whatever its relief.  The first gathers inside tiles and says, for the cells where water leaves a tile, how much of the tile
    drains there, and for cells at a tile's rim, where what enters them leaves.  Leaving cells alone are then a forest, about 4 / tile of the cells, which is summed
    down; the second pass gathers inside tiles again, with what enters.
    """
    own = [F.floor(F.col(k) / tile).alias(t) for k, t in (("r", "tr"), ("c", "tc"))]
    cells = stored(flow.select("r", "c", F.col("to_r").cast("long").alias("to_r"), F.col("to_c").cast("long").alias("to_c"), *own))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        f = _tile_flow(pdf)
        end, r, c = f.ends(), pdf["r"].to_numpy(), pdf["c"].to_numpy()
        leaves = (f.to < 0) & pdf["to_r"].notna().to_numpy()
        rim = (r % tile == 0) | (r % tile == tile - 1) | (c % tile == 0) | (c % tile == tile - 1)
        keep = leaves | rim
        return pd.DataFrame({"r": r, "c": c, "leaves": leaves, "to_r": pdf["to_r"], "to_c": pdf["to_c"], "end_r": r[end], "end_c": c[end], "ends": leaves[end], "acc": f.gathered(np.ones(len(r), np.int64))})[keep]

    rims = stored(cells.groupBy("tr", "tc").applyInPandas(first, "r long, c long, leaves boolean, to_r long, to_c long, end_r long, end_c long, ends boolean, acc long"))
    out = rims.filter("leaves")
    # The leaving cell that follows: where the way goes on from the cell that is entered.
    onward = rims.filter("ends").select(F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.col("end_r").alias("pr"), F.col("end_c").alias("pc"))
    total = summed_down(out.join(onward, ["to_r", "to_c"], "left").select("r", "c", "pr", "pc", "acc"))
    enters = out.select("r", "c", "to_r", "to_c").join(total, ["r", "c"]).groupBy(F.col("to_r").alias("r"), F.col("to_c").alias("c")).agg(F.sum("acc").alias("more"))
    fed = cells.join(enters, ["r", "c"], "left").withColumn("weight", F.lit(1).cast("long") + F.coalesce("more", F.lit(0))).drop("more")

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["r", "c"]].assign(acc=_tile_flow(pdf).gathered(pdf["weight"].to_numpy(np.int64)))

    return fed.groupBy("tr", "tc").applyInPandas(second, "r long, c long, acc long")


def wetness_index(dem: DataFrame, dx: float, dy: float, value: str = "z", least_slope: float = 0.1) -> DataFrame:
    """(r, c, value): ln(area drained per width / tan(slope)), the slope at least least_slope degrees."""
    acc = flow_accumulation(flow_direction(fill_depressions(dem, value), dx, dy))
    steep = slope(dem, value, dx, dy).select("r", "c", F.col("value").alias("s"))
    area = F.col("acc") * dx * dy / ((dx + dy) / 2)
    return acc.join(steep, ["r", "c"]).select("r", "c", F.log(area / F.tan(F.radians(F.greatest("s", F.lit(least_slope))))).alias("value"))


def elevation_profile(dem: DataFrame, value: str, start: tuple[float, float], end: tuple[float, float], cell: float, samples: int = 500) -> DataFrame:
    """(k, distance, z) of bilinear samples between two (row, column) places; missing corners leave their weight to the others."""
    (r0, c0), (r1, c1) = start, end
    far = ((r1 - r0) ** 2 + (c1 - c0) ** 2) ** 0.5 * cell
    t = F.col("id") / F.lit(float(samples - 1))
    at = dem.sparkSession.range(samples).select(F.col("id").alias("k"), (F.lit(r0) + t * (r1 - r0)).alias("y"), (F.lit(c0) + t * (c1 - c0)).alias("x"), (t * far).alias("distance"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    near = at.withColumn("o", F.explode(corners)).withColumns({"r": F.floor("y") + F.col("o.i"), "c": F.floor("x") + F.col("o.j")})
    near = near.withColumn("wt", (1 - F.abs(F.col("y") - F.col("r"))) * (1 - F.abs(F.col("x") - F.col("c"))))
    got = near.join(dem.filter(F.col(value).isNotNull()).select("r", "c", F.col(value).alias("v")), ["r", "c"]).groupBy("k").agg(F.try_divide(F.sum(F.col("wt") * F.col("v")), F.sum("wt")).alias("z"))
    return at.join(got, "k", "left").select("k", "distance", "z")
