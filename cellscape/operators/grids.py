"""Rasters on other grids: coordinate systems, alignment, warping, crops, lookups, series and the guard of comparisons.

A grid has a system (EPSG number), the coordinates of its upper left corner, cell sizes and its shape; row r and column c of
its cells have the centre (x0 + (c + 0.5) dx, y0 - (r + 0.5) dy).  Cell tables carry r and c only, grids come from the raster catalog.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("nearest", "bilinear", "cubic", "average", "mode")
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


@dataclass(frozen=True)
class Grid:
    srid: int
    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """West, south, east, north."""
        return self.x0, self.y0 - self.height * self.dy, self.x0 + self.width * self.dx, self.y0

    def on_earth(self) -> "Grid":
        """A grid in degrees without the rows that reach a pole or lie beyond it: they have no place in any other system."""
        if self.srid != 4326:
            return self
        edge = self.y0 - self.dy * np.arange(self.height + 1)
        kept = np.flatnonzero(np.abs(edge) < 90.0)
        if len(kept) < 2:
            raise ValueError("the grid holds no row between the poles")
        return replace(self, y0=self.y0 - float(kept[0]) * self.dy, height=int(kept[-1] - kept[0]))

    def same(self, other: "Grid", tol: float = 1e-6) -> bool:
        terms = ("x0", "y0", "dx", "dy")
        return (self.srid, self.width, self.height) == (other.srid, other.width, other.height) and all(abs(getattr(self, k) - getattr(other, k)) <= tol for k in terms)

    def cells(self, spark: SparkSession) -> DataFrame:
        """(r, c) of the whole rectangle."""
        return spark.range(self.width * self.height).select(F.floor(F.col("id") / self.width).alias("r"), (F.col("id") % self.width).alias("c"))


def _zone(srid: int) -> tuple[int, bool] | None:
    """Number and hemisphere of a UTM system on WGS84."""
    zone, south = srid % 100, srid // 100 == 327
    return (zone, south) if srid // 100 in (326, 327) and 1 <= zone <= 60 else None


def to_lonlat(x, y, srid: int, m=F):
    """Longitude and latitude of coordinates; columns, or numbers with m=numpy.  UTM by the Krueger series to the third order."""
    if srid == 4326:
        return x, y
    if srid == 3857:
        return m.degrees(x / _A), m.degrees(2 * m.atan(m.exp(y / _A)) - math.pi / 2)
    if (zone := _zone(srid)) is None:
        raise ValueError(f"system {srid} is not known: 4326, 3857 and UTM (326zz, 327zz) are")
    number, south = zone
    beta = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
    delta = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
    xi, eta = (y - (10_000_000.0 if south else 0.0)) / (0.9996 * _RADIUS), (x - 500_000.0) / (0.9996 * _RADIUS)
    p, q = xi, eta
    for j, k in enumerate(beta, 1):
        p = p - k * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        q = q - k * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    chi = m.asin(m.sin(p) / m.cosh(q))
    phi = chi
    for j, k in enumerate(delta, 1):
        phi = phi + k * m.sin(2 * j * chi)
    return number * 6 - 183 + m.degrees(m.atan2(m.sinh(q), m.cos(p))), m.degrees(phi)


def from_lonlat(lon, lat, srid: int, m=F):
    """Coordinates of longitude and latitude in a system."""
    if srid == 4326:
        return lon, lat
    if srid == 3857:
        return m.radians(lon) * _A, m.log(m.tan(math.pi / 4 + m.radians(lat) / 2)) * _A
    if (zone := _zone(srid)) is None:
        raise ValueError(f"system {srid} is not known: 4326, 3857 and UTM (326zz, 327zz) are")
    number, south = zone
    alpha = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
    e = 2 * _N**0.5 / (1 + _N)
    phi, lam = m.radians(lat), m.radians(lon - (number * 6 - 183))
    t = m.sinh(m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi)))
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
    east, north = eta, xi
    for j, k in enumerate(alpha, 1):
        east = east + k * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        north = north + k * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    return 500_000.0 + 0.9996 * _RADIUS * east, (10_000_000.0 if south else 0.0) + 0.9996 * _RADIUS * north


def reproject(x, y, source: int, target: int, m=F):
    """Coordinates of one system in another."""
    return (x, y) if source == target else from_lonlat(*to_lonlat(x, y, source, m), target, m)


def envelope(box: tuple[float, float, float, float], source: int, target: int) -> tuple[float, float, float, float]:
    """The box around a box's four corners in another system."""
    west, south, east, north = box
    x, y = reproject(np.array([west, east, west, east]), np.array([south, south, north, north]), source, target, np)
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())


def _weight(t: Column, method: str) -> Column:
    t = F.abs(t)
    if method == "bilinear":
        return F.greatest(F.lit(0.0), 1 - t)
    # Keys' kernel with a = -0.5.
    return F.when(t <= 1, 1.5 * t * t * t - 2.5 * t * t + 1).when(t < 2, -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2).otherwise(0.0)


def align_to(cells: DataFrame, source: Grid, target: Grid, bands: Sequence[str], method: str = "bilinear") -> DataFrame:
    """(r, c, bands) on the target grid, one row for each of its cells.

    nearest takes the source cell that holds the target cell's centre; bilinear and cubic weight 4 and 16 cells about it (missing or
    outside cells leave their weight to the others); average and mode take the source cells whose centres are inside, or the nearest
    where there is none.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    bands, spark = list(bands), cells.sparkSession
    s = cells.select(F.col("r").alias("sr"), F.col("c").alias("sc"), *bands)
    if source.same(target):
        return target.cells(spark).join(cells.select("r", "c", *bands), ["r", "c"], "left")
    x, y = reproject(target.x0 + (F.col("c") + 0.5) * target.dx, target.y0 - (F.col("r") + 0.5) * target.dy, target.srid, source.srid)
    at = target.cells(spark).withColumns({"fy": (source.y0 - y) / source.dy, "fx": (x - source.x0) / source.dx})
    if method in ("nearest", "average", "mode"):
        out = at.select("r", "c", F.floor("fy").alias("sr"), F.floor("fx").alias("sc")).join(s, ["sr", "sc"], "left").select("r", "c", *bands)
        if method == "nearest":
            return out
        sx, sy = reproject(source.x0 + (F.col("sc") + 0.5) * source.dx, source.y0 - (F.col("sr") + 0.5) * source.dy, source.srid, target.srid)
        of = F.avg if method == "average" else lambda b: F.mode(b, True)
        inside = s.groupBy(F.floor((target.y0 - sy) / target.dy).alias("r"), F.floor((sx - target.x0) / target.dx).alias("c")).agg(F.count("*").alias("_n"), *[of(b).alias(f"_{b}") for b in bands])
        both = out.join(inside, ["r", "c"], "left")
        return both.select("r", "c", *[F.when(F.col("_n") > 0, F.col(f"_{b}")).otherwise(F.col(b)).alias(b) for b in bands])
    reach = (0, 1) if method == "bilinear" else (-1, 0, 1, 2)
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in reach for j in reach])
    near = at.withColumn("o", F.explode(offsets)).withColumns({"sr": F.floor(F.col("fy") - 0.5) + F.col("o.i"), "sc": F.floor(F.col("fx") - 0.5) + F.col("o.j")})
    near = near.withColumn("wt", _weight(F.col("fy") - 0.5 - F.col("sr"), method) * _weight(F.col("fx") - 0.5 - F.col("sc"), method))
    held = lambda b: F.when(F.col(b).isNotNull(), F.col("wt"))
    got = near.join(s, ["sr", "sc"]).groupBy("r", "c").agg(*[F.try_divide(F.sum(F.col("wt") * F.col(b)), F.sum(held(b))).alias(b) for b in bands])
    return target.cells(spark).join(got, ["r", "c"], "left")


def common_grid(grids: Sequence[Grid], srid: int | None = None, resolution: float | None = None) -> Grid:
    """The grid around all grids in a system (the first one's by default) at a resolution (the first one's, or as many cells across).

    Another system than a grid's own has no place for rows in degrees at or beyond the poles; the grid is then around the others.
    """
    srid = grids[0].srid if srid is None else srid
    grids = [g if g.srid == srid else g.on_earth() for g in grids]
    first = grids[0]
    boxes = [envelope(g.bounds, g.srid, srid) for g in grids]
    west, south, east, north = (f(b[k] for b in boxes) for k, f in enumerate((min, min, max, max)))
    if resolution is not None and resolution <= 0:
        raise ValueError("resolution must be positive")
    if resolution is not None:
        dx = dy = float(resolution)
    elif srid == first.srid:
        dx, dy = first.dx, first.dy
    else:
        w, s, e, n = boxes[0]
        dx, dy = (e - w) / first.width, (n - s) / first.height
    return Grid(srid, west, north, dx, dy, max(1, math.ceil((east - west) / dx - 1e-9)), max(1, math.ceil((north - south) / dy - 1e-9)))


def warp(sources: Sequence[tuple[DataFrame, Grid]], bands: Sequence[str], srid: int | None = None, resolution: float | None = None, method: str = "bilinear") -> tuple[DataFrame, Grid]:
    """All sources on one grid of a system and resolution; where they overlap, a later one that has data wins."""
    target, bands = common_grid([g for _, g in sources], srid, resolution), list(bands)
    out = None
    for k, (cells, grid) in enumerate(sources):
        one = align_to(cells, grid, target, bands, method).withColumn("_layer", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("r", "c").agg(*[F.max_by(b, F.when(F.col(b).isNotNull(), F.col("_layer"))).alias(b) for b in bands]), target


@dataclass(frozen=True)
class Scene:
    """A raster of a series: its name, acquisition date (ISO text, or None), grid and cells."""

    name: str
    date: str | None
    grid: Grid
    cells: DataFrame


def load_series(scenes: Sequence[Scene], band: str = "value", method: str = "bilinear", reader: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(t, d, r, c, value): scenes in order of their dates, on the grid of the oldest; `reader` makes (r, c, band) of a scene's aligned cells."""
    if not scenes:
        raise ValueError("there must be a scene")
    if missing := [s.name for s in scenes if not s.date]:
        raise ValueError(f"no acquisition date: {missing}")
    ordered, out = sorted(scenes, key=lambda s: s.date), None
    for t, s in enumerate(ordered):
        bands = [n for n in s.cells.columns if n not in ("r", "c")] if reader is not None else [band]
        cells = s.cells if s.grid.same(ordered[0].grid) else align_to(s.cells, s.grid, ordered[0].grid, bands, method)
        one = (cells if reader is None else reader(cells)).select(F.lit(t).alias("t"), F.lit(s.date).cast("date").alias("d"), "r", "c", F.col(band).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def change_guard(before: Scene, after: Scene) -> None:
    """Refuse a comparison of a raster with itself, of one date, or of rasters on different grids."""
    if before.name == after.name:
        raise ValueError("before and after are the same raster: change needs two dates")
    if before.date and after.date and before.date == after.date:
        raise ValueError("before and after have the same acquisition date")
    if not before.grid.same(after.grid):
        raise ValueError("before and after are on different grids: align them first")


def crop(cells: DataFrame, grid: Grid, box: tuple[float, float, float, float], bands: Sequence[str], srid: int | None = None, most: int = 2048) -> tuple[DataFrame, Grid]:
    """(r, c, bands) of a box and its grid, decimated by means to at most `most` cells a side.

    The box is west, south, east, north in a system, or without one left, top, right, bottom as shares of the raster.
    """
    if srid is None:
        left, top, right, bottom = box
        c0, c1, r0, r1 = left * grid.width, right * grid.width, top * grid.height, bottom * grid.height
    else:
        w, s, e, n = envelope(box, srid, grid.srid)
        c0, c1, r0, r1 = (w - grid.x0) / grid.dx, (e - grid.x0) / grid.dx, (grid.y0 - n) / grid.dy, (grid.y0 - s) / grid.dy
    c0, r0 = max(0, math.floor(c0 + 1e-9)), max(0, math.floor(r0 + 1e-9))
    c1, r1 = min(grid.width, math.ceil(c1 - 1e-9)), min(grid.height, math.ceil(r1 - 1e-9))
    if c0 >= c1 or r0 >= r1:
        raise ValueError("the box holds no cell of the raster")
    step = max(1.0, max(c1 - c0, r1 - r0) / most)
    kept = cells.filter((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))
    out = kept.groupBy(F.floor((F.col("r") - r0) / F.lit(step)).alias("r"), F.floor((F.col("c") - c0) / F.lit(step)).alias("c")).agg(*[F.avg(b).alias(b) for b in bands])
    return out, Grid(grid.srid, grid.x0 + c0 * grid.dx, grid.y0 - r0 * grid.dy, grid.dx * step, grid.dy * step, math.ceil((c1 - c0) / step), math.ceil((r1 - r0) / step))


def pixel_lookup(points: DataFrame, cells: DataFrame, grid: Grid, band: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with (r, c, value, nodata) of the cell that holds each; outside the raster r, c and value are null."""
    x, y = from_lonlat(F.col(lon), F.col(lat), grid.srid)
    r, c = F.floor((grid.y0 - y) / grid.dy), F.floor((x - grid.x0) / grid.dx)
    inside = (r >= 0) & (r < grid.height) & (c >= 0) & (c < grid.width)
    at = points.withColumns({"r": F.when(inside, r), "c": F.when(inside, c)})
    return at.join(cells.select("r", "c", F.col(band).alias("value")), ["r", "c"], "left").withColumn("nodata", F.col("value").isNull())


def ortho_by_lookup(lookup: DataFrame, cells: DataFrame, bands: Sequence[str]) -> DataFrame:
    """(r, c, bands): each output cell (r, c, gy, gx) takes the sensor cell (gy - 1, gx - 1); 0 is no data, and so are values below -1."""
    s = cells.select((F.col("r") + 1).alias("gy"), (F.col("c") + 1).alias("gx"), *[F.when(F.col(b) >= -1, F.col(b)).alias(b) for b in bands])
    known = lookup.select("r", "c", *[F.when(F.col(k) > 0, F.col(k)).alias(k) for k in ("gy", "gx")])
    return known.join(s, ["gy", "gx"], "left").select("r", "c", *bands)
