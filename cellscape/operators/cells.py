"""Operators on cell tables: one row a grid cell, one nullable DOUBLE column a band, NULL for no data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.functions.indices import INDICES, index
from cellscape.functions.sar import to_db
from cellscape.operators.quantiles import with_quantiles


class BandError(ValueError):
    """A band is missing or ambiguous."""


def with_scalars(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    """df with each raster's aggregates beside every cell: one partial aggregation and a small join, no collect."""
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*aggs)))
    return df.join(df.groupBy(*by).agg(*aggs), list(by))


def scan_band(cells: DataFrame, band: str, nodata: float | None = None, keys: Sequence[str] = ("r", "c")) -> DataFrame:
    if band not in cells.columns:
        raise BandError(f"no band {band!r}")
    value = F.col(band) if nodata is None else F.nullif(F.col(band), F.lit(nodata))
    return cells.select(*keys, value.alias("value"))


def resolve_role(catalog: DataFrame, role: str, explicit: int | None = None) -> str:
    """The label of the only band with that role; an explicit number must not carry another role."""
    rows = catalog.filter((F.col("role") == role) if explicit is None else (F.col("band") == explicit)).select("label", "role").limit(2).collect()
    if len(rows) != 1 or (explicit is not None and rows[0]["role"] not in (None, role)):
        raise BandError(f"role {role!r}: {len(rows)} bands" if len(rows) != 1 else f"band {explicit} is labelled {rows[0]['role']!r}, not {role!r}")
    return rows[0]["label"]


def scan_role(cells: DataFrame, catalog: DataFrame, role: str, explicit: int | None = None) -> DataFrame:
    return scan_band(cells, resolve_role(catalog, role, explicit))


def with_tiles(cells: DataFrame, size: int = 1024) -> DataFrame:
    """Tile numbers beside each cell; write partitioned by them so that a window read prunes files."""
    return cells.withColumns({"tile_r": F.floor(F.col("r") / size), "tile_c": F.floor(F.col("c") / size)})


def _spaced(x: Column) -> Column:
    """The bits of a number below 2 ** 31, each followed by a 0 bit."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(r: Column, c: Column) -> Column:
    """The place of a tile (r, c), both from 0, on the Morton curve: near tiles have near numbers."""
    return F.shiftleft(_spaced(r.cast("long")), 1).bitwiseOR(_spaced(c.cast("long")))


def morton_ranges(r0: int, r1: int, c0: int, c1: int, most: int = 32) -> list[tuple[int, int]]:
    """Ranges (first, last) of the Morton curve that hold all tiles r0..r1 x c0..c1: squares of the curve that lie inside, and squares
    at the rim, cut further as long as that makes at most `most` ranges."""
    size = 1
    while size <= max(r1, c1):
        size *= 2

    def merged(squares: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for at, n in sorted((at, n) for at, _, _, n in squares):
            if out and out[-1][1] + 1 == at:
                out[-1][1] = at + n * n - 1
            else:
                out.append([at, at + n * n - 1])
        return [(a, b) for a, b in out]

    squares, best = [(0, 0, 0, size)], [(0, size * size - 1)]
    while True:
        rim = [s for s in squares if s[3] > 1 and not (r0 <= s[1] and s[1] + s[3] - 1 <= r1 and c0 <= s[2] and s[2] + s[3] - 1 <= c1)]
        if not rim:
            return best
        large = max(s[3] for s in rim)
        cut = {s for s in rim if s[3] == large}
        kids = [(at + k * (large // 2) ** 2, r + (k >> 1) * (large // 2), c + (k & 1) * (large // 2), large // 2) for at, r, c, _ in cut for k in range(4)]
        squares = [s for s in squares if s not in cut] + [k for k in kids if k[1] <= r1 and k[1] + k[3] > r0 and k[2] <= c1 and k[2] + k[3] > c0]
        now = merged(squares)
        if len(now) > most:
            return best
        best = now


def window_of_tiles(cells: DataFrame, r0: int, r1: int, c0: int, c1: int, size: int = 1024) -> DataFrame:
    """Cells of rows r0..r1-1 and columns c0..c1-1 of a table that write_tiles wrote with the same size: a few ranges of `tile` prune files and row groups
    by their statistics; where there are tile_r and tile_c instead, those do."""
    inside = (F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1)
    if "tile" in cells.columns:
        tiles = F.lit(False)
        for a, b in morton_ranges(max(0, r0) // size, max(0, r1 - 1) // size, max(0, c0) // size, max(0, c1 - 1) // size):
            tiles = tiles | F.col("tile").between(a, b)
    else:
        tiles = F.col("tile_r").between(r0 // size, (r1 - 1) // size) & F.col("tile_c").between(c0 // size, (c1 - 1) // size)
    return cells.filter(tiles & inside)


def aoi_window(cells: DataFrame, r0: int, r1: int, c0: int, c1: int, nodata: float | None = 0.0, band: str = "value", most: int | None = None) -> DataFrame:
    """One row: cells of the window and the percentage that is valid; refuses windows above `most` cells, if given."""
    if most is not None and (r1 - r0) * (c1 - c0) > most:
        raise ValueError(f"window of {(r1 - r0) * (c1 - c0)} cells; the limit is {most}")
    inside = cells.filter((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))
    valid = F.col(band).isNotNull() & (F.col(band) != 0) & (F.lit(True) if nodata is None else F.col(band) != nodata)
    return inside.agg(F.count("*").alias("n"), F.count_if(valid).alias("valid")).withColumn("valid_pct", F.bround(F.try_divide(F.col("valid") * 100.0, F.col("n")), 4))


def write_tiles(cells: DataFrame, path: str, size: int = 512, by: Sequence[str] = (), files: int | None = None, rows_a_file: int | None = None) -> None:
    """Parquet in Morton order of tiles (column `tile`; rows and columns from 0), zstd: files and row groups are ranges of the curve, so a window
    reads few of them, and there are as many files as partitions (`files`), not as tiles.  `by` keys come before the curve."""
    tiled = cells.withColumn("tile", morton(F.floor(F.col("r") / size), F.floor(F.col("c") / size)))
    order = [*map(F.col, by), F.col("tile")]
    dealt = tiled.repartitionByRange(files, *order) if files else tiled.repartitionByRange(*order)
    writer = dealt.sortWithinPartitions(*order, "r", "c").write.mode("overwrite").option("compression", "zstd")
    (writer.option("maxRecordsPerFile", rows_a_file) if rows_a_file else writer).parquet(path)


def write_band(values: DataFrame, path: str, nodata: float | None = None, column: str = "value") -> None:
    """Write one band; booleans become 0 and 1; a no-data value that occurs as data is refused."""
    if dict(values.dtypes)[column] == "boolean":
        values = values.withColumn(column, F.col(column).cast("tinyint"))
    if nodata is not None and values.filter(F.col(column) == nodata).limit(1).count():
        raise ValueError(f"no-data value {nodata} occurs as data")
    out = values if nodata is None else values.withColumn(column, F.coalesce(column, F.lit(nodata)))
    out.write.mode("overwrite").parquet(path)


def map_tiles(cells: DataFrame, function, schema: str, size: int = 1024, by: Sequence[str] = ()) -> DataFrame:
    """Apply function(pandas frame of one tile) -> pandas frame to every tile."""
    return with_tiles(cells, size).groupBy(*by, "tile_r", "tile_c").applyInPandas(function, schema)


def surface_reflectance(cells: DataFrame, bands: Sequence[str], sensor: str = "sentinel2", baseline: float | None = None, date: str | None = None, boa_offset: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Digital numbers to reflectance 0.0001..1.5, band by band; a band whose 99th percentile is at most 2 is one already.

    Landsat: DN * 2.75e-5 - 0.2.  Others: (DN + offset) / 10000; the offset is the tag's, or -1000 from processing
    baseline 4 on, or, without a baseline, from 2022-01-25 on where the 1st percentile is above 700.
    """
    out = with_quantiles(cells, {f"__p_{b}": (b, (0.01, 0.99)) for b in bands}, by)
    for b in bands:
        p1, p99 = F.col(f"__p_{b}")[0], F.col(f"__p_{b}")[1]
        if sensor == "landsat":
            value = F.col(b) * 2.75e-5 - 0.2
        else:
            if boa_offset is not None:
                offset = F.lit(float(boa_offset))
            elif baseline is not None:
                offset = F.lit(-1000.0 if baseline >= 4 else 0.0)
            elif date is not None and date >= "2022-01-25":
                offset = F.when(p1 > 700, -1000.0).otherwise(0.0)
            else:
                offset = F.lit(0.0)
            value = (F.col(b) + offset) / 10000.0
        value = F.greatest(F.lit(0.0001), F.least(F.lit(1.5), value))
        out = out.withColumn(b, F.when(F.col(b).isNull(), None).when(p99 <= 2, F.col(b)).otherwise(value))
    return out.drop(*[f"__p_{b}" for b in bands])


def autoscaled(cells: DataFrame, band: str, by: Sequence[str] = ()) -> DataFrame:
    """v / 10000 clipped to 0..1.5 where the 99th percentile is above 2."""
    out = with_quantiles(cells, {"__p": (band, (0.99,))}, by)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.5), F.col(band) / 10000.0))
    return out.withColumn(band, F.when(F.col(band).isNull(), None).when(F.col("__p")[0] > 2, scaled).otherwise(F.col(band))).drop("__p")


def celsius(cells: DataFrame, band: str = "thermal", by: Sequence[str] = ()) -> DataFrame:
    """Thermal band in degrees Celsius, by the raster's median: scaled numbers, Kelvin, or Celsius already."""
    out = with_quantiles(cells, {"__m": (band, (0.5,))}, by)
    m = F.col("__m")[0]
    value = F.when(m > 1000, F.col(band) * 0.00341802 + 149.0 - 273.15).when((m >= 180) & (m <= 360), F.col(band) - 273.15).otherwise(F.col(band))
    return out.withColumn(band, value).drop("__m")


def compute_index(cells: DataFrame, name: str, catalog: DataFrame | None = None, explicit: dict[str, int] | None = None, by: Sequence[str] = (), **calibration) -> DataFrame:
    """(keys, value): roles resolved, bands calibrated, formula applied in one projection."""
    if name.lower() not in INDICES:
        raise ValueError(f"unknown index {name!r}")
    roles = INDICES[name.lower()].roles
    label = {r: resolve_role(catalog, r, (explicit or {}).get(r)) if catalog is not None else r for r in roles}
    cells = cells.select(*by, "r", "c", *[F.col(label[r]).alias(r) for r in roles])
    cells = celsius(cells, "thermal", by) if roles == ("thermal",) else surface_reflectance(cells, roles, by=by, **calibration)
    return cells.select(*by, "r", "c", index(name).alias("value"))


def backscatter_db(cells: DataFrame, band: str, by: Sequence[str] = ()) -> DataFrame:
    """Radar in dB: kept where the median is negative, converted where the 99th percentile is at most 5, else an error."""
    out = with_quantiles(cells, {"__p": (band, (0.5, 0.99))}, by)
    value = F.when(F.col("__p")[0] < 0, F.col(band)).when(F.col("__p")[1] <= 5, to_db(F.col(band))).otherwise(F.raise_error(F.lit("uncalibrated backscatter")).cast("double"))
    return out.withColumn(band, value).drop("__p")


def select_extreme(cells: DataFrame, column: str = "value", fraction: float = 0.2, keep: str = "high", by: Sequence[str] = ()) -> DataFrame:
    """The cells in the top or bottom fraction by a linear quantile cutoff, ties kept, with the cutoff."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    if keep not in ("high", "low"):
        raise ValueError("keep must be 'high' or 'low'")
    out = with_quantiles(cells, {"cutoff": (column, (1 - fraction if keep == "high" else fraction,))}, by).withColumn("cutoff", F.col("cutoff")[0])
    return out.filter(F.col(column) >= F.col("cutoff") if keep == "high" else F.col(column) <= F.col("cutoff"))


def significant_change(cells: DataFrame, column: str = "value", direction: str = "decrease", n_std: float = 1.0, threshold: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Cells that changed by at least the cutoff: the threshold given, or n_std population deviations."""
    out = with_scalars(cells, by, (F.stddev_pop(column) * n_std if threshold is None else F.max(F.lit(threshold))).alias("cutoff"))
    return out.filter(F.col(column) <= -F.col("cutoff") if direction == "decrease" else F.col(column) >= F.col("cutoff"))


def combine_masks(masks: Sequence[DataFrame], how: str, keys: Sequence[str] = ("r", "c")) -> DataFrame:
    """Masks as sets of cells: and, or, and_not (the first without all others)."""
    out = masks[0].select(*keys)
    for m in masks[1:]:
        other = m.select(*keys)
        if how == "and":
            out = out.intersect(other)
        elif how == "or":
            out = out.union(other)
        elif how == "and_not":
            out = out.join(other, list(keys), "left_anti")
        else:
            raise ValueError("how must be 'and', 'or' or 'and_not'")
    return out.distinct()


def cloud_flag(method: str, blue: str = "blue", green: str = "green", red: str = "red", swir: str = "swir1", scale: Column | float = 1.0) -> Column:
    """Whether a cell is cloud: by scene class, by quality bits, or by brightness."""
    if method == "scl":
        return F.col("scl").isin(3, 8, 9, 10)
    if method == "qa":
        return F.col("qa60").bitwiseAND(F.lit((1 << 10) | (1 << 11))) != 0
    if method == "spectral":
        return ((F.col(blue) + F.col(red)) / 2 / scale > 0.35) & (F.col(swir) / scale > 0.20)
    raise ValueError("method must be 'scl', 'qa' or 'spectral'")


def cloud_fraction(cells: DataFrame, method: str) -> DataFrame:
    """One row: the share of cloud cells, 4 decimals; scene class 0 is no data and does not count."""
    if method == "scl":
        cells = cells.filter("scl <> 0")
    if method == "spectral":
        cells = with_scalars(cells, (), F.max("red").alias("__max"))
        flag = cloud_flag(method, scale=F.when(F.col("__max") > 10, 10000.0).otherwise(1.0))
    else:
        flag = cloud_flag(method)
    return cells.agg(F.count("*").alias("n"), F.count_if(flag).alias("cloud")).withColumn("fraction", F.bround(F.try_divide(F.col("cloud").cast("double"), F.col("n")), 4))


def stretch(cells: DataFrame, band: str, by: Sequence[str] = ()) -> DataFrame:
    """Percentile stretch to 0..255: (v - p2) / (p98 - p2), clipped."""
    out = with_quantiles(cells, {"__p": (band, (0.02, 0.98))}, by)
    t = F.try_divide(F.col(band) - F.col("__p")[0], F.col("__p")[1] - F.col("__p")[0])
    value = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * 255).cast("int")
    return out.withColumn(band, F.when(t.isNotNull(), value)).drop("__p")
