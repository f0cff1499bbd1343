"""Stacks of neighbourhood features in one shuffle: tiles with a halo, all boxes inside a task.

A tile of TILE x TILE cells comes with HALO cells around it, more than the widest chain of boxes reaches, so what is made up at the rim of the halo
never gets into the tile.  At the raster's own edges boxes mirror (the edge cell included), and the local binary pattern wraps: cells of the edges
travel once more, to beyond the opposite edge.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.operators.focal import extents

TILE, HALO = 256, 16


def haloed(cells: DataFrame, columns: Sequence[str], by: Sequence[str] = (), tile: int = TILE, halo: int = HALO) -> DataFrame:
    """(by, tr, tc, r, c, columns, beyond, r0, r1, c0, c1): the cells of each tile and its halo; `beyond` marks edge cells that stand beyond the opposite edge."""
    wide = extents(cells.select(*by, "r", "c", *columns), by).withColumnsRenamed({"__r0": "r0", "__r1": "r1", "__c0": "c0", "__c1": "c1"})

    def places(x: str, lo: str, hi: str) -> Column:
        """array<tile, at, beyond> of a cell along an axis."""
        place = lambda t, at, beyond: F.struct(t.alias("t"), at.cast("long").alias("at"), F.lit(beyond).alias("beyond"))

        def about(at: Column, beyond: bool) -> Column:
            """The place `at` in all tiles that have it in their halo."""
            first, last = F.greatest(F.floor((at - halo) / tile), F.floor(F.col(lo) / tile)), F.least(F.floor((at + halo) / tile), F.floor(F.col(hi) / tile))
            return F.transform(F.sequence(first, last), lambda t: place(t, at, beyond))

        near = about(F.col(x), False)
        first = F.when(F.col(x) == F.col(lo), about(F.col(hi) + 1, True))
        last = F.when(F.col(x) == F.col(hi), about(F.col(lo) - 1, True))
        return F.flatten(F.array_compact(F.array(near, first, last)))

    out = wide.withColumn("__p", F.explode(places("r", "r0", "r1"))).withColumn("__q", F.explode(places("c", "c0", "c1")))
    return out.select(*by, F.col("__p.t").alias("tr"), F.col("__q.t").alias("tc"), F.col("__p.at").alias("r"), F.col("__q.at").alias("c"), *columns, (F.col("__p.beyond") | F.col("__q.beyond")).alias("beyond"), "r0", "r1", "c0", "c1")


class Patch:
    """The arrays of one tile with its halo, and which of its rims are the raster's edges."""

    def __init__(self, pdf: pd.DataFrame, columns: Sequence[str]):
        real = pdf[~pdf["beyond"]]
        self.pdf, self.r0, self.c0 = pdf, int(real["r"].min()), int(real["c"].min())
        self.shape = int(real["r"].max()) - self.r0 + 1, int(real["c"].max()) - self.c0 + 1
        self.low = self.r0 == pdf["r0"].iloc[0], self.c0 == pdf["c0"].iloc[0]
        self.high = self.r0 + self.shape[0] - 1 == pdf["r1"].iloc[0], self.c0 + self.shape[1] - 1 == pdf["c1"].iloc[0]
        at = real["r"].to_numpy() - self.r0, real["c"].to_numpy() - self.c0
        self.layers = {}
        for n in columns:
            self.layers[n] = np.full(self.shape, np.nan)
            self.layers[n][at] = real[n].to_numpy(np.float64)

    def padded(self, a: np.ndarray, reach: int, axis: int) -> np.ndarray:
        """One axis longer by `reach` at both ends: mirrored once at the raster's edges, 0 where that is outside as well."""
        n = a.shape[axis]
        place = np.arange(-reach, n + reach)
        low, high = self.low[axis] & (place < 0), self.high[axis] & (place >= n)
        at = np.where(low, -1 - place, np.where(high, 2 * n - 1 - place, place))
        ok = (at >= 0) & (at < n)
        out = a.take(np.clip(at, 0, n - 1), axis=axis)
        return out if ok.all() else out * (ok[:, None] if axis == 0 else ok[None, :])

    def mean(self, a: np.ndarray, size: int) -> np.ndarray:
        """Means over size x size boxes."""
        for axis in (1, 0):
            p, n = self.padded(a, size // 2, axis), a.shape[axis]
            a = sum((p[k : k + n] if axis == 0 else p[:, k : k + n]) for k in range(size))
        return a / float(size * size)

    def slope(self, a: np.ndarray) -> np.ndarray:
        """Length of the Sobel gradient."""
        p = self.padded(self.padded(a, 1, 1), 1, 0)
        h, w = a.shape
        row = lambda k: (p[k : k + h, :-2], p[k : k + h, 1:-1], p[k : k + h, 2:])
        across = [e - west for west, _, e in map(row, range(3))]
        along = [west + 2 * m + e for west, m, e in map(row, range(3))]
        return np.hypot(across[0] + 2 * across[1] + across[2], along[2] - along[0])

    def pattern(self, of) -> np.ndarray:
        """How many of the 8 neighbours, wrapped around the raster, are at most the cell, of the values `of(frame)`."""
        h, w = self.shape
        ring = np.full((h + 2, w + 2), np.nan)
        ring[self.pdf["r"].to_numpy() - self.r0 + 1, self.pdf["c"].to_numpy() - self.c0 + 1] = of(self.pdf)
        centre = ring[1:-1, 1:-1]
        return sum((ring[i : i + h, j : j + w] <= centre).astype(np.float64) for i in range(3) for j in range(3) if (i, j) != (1, 1))


def in_tiles(cells: DataFrame, columns: Sequence[str], function, names: Sequence[str], by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """(by, r, c, names) of a whole rectangle: function(Patch) -> arrays by name, over the patch; the halo is cut off."""
    spread = haloed(cells, columns, by, tile)
    kinds = dict(spread.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        patch = Patch(pdf, columns)
        found = function(patch)
        real = pdf[~pdf["beyond"]]
        own = real[(real["r"] // tile == real["tr"]) & (real["c"] // tile == real["tc"])]
        at = own["r"].to_numpy() - patch.r0, own["c"].to_numpy() - patch.c0
        return own[[*by, "r", "c"]].assign(**{n: found[n][at] for n in names})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "r long", "c long", *(f"{n} double" for n in names)])
    return spread.groupBy(*by, "tr", "tc").applyInPandas(run, schema)
