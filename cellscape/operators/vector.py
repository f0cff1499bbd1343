"""Polygon, point and zone operators.

Polygons are rings of vertices, ARRAY<ARRAY<STRUCT<x,y>>>, the first ring outside, further rings holes.  A cell belongs to a
polygon when its centre (c + 0.5, r + 0.5) is inside by the even-odd rule.  Coordinates are in cell units, or in the units of the points.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.operators import leaves
from cellscape.operators.quantiles import quantiles


def triangle(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A one-ring polygon of three vertices."""
    v = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(v(x0, y0), v(x1, y1), v(x2, y2)))


def edges(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, xa, ya, xb, yb): every edge of every ring, the closing one included."""
    ring = polygons.select(key, F.explode(rings).alias("ring"))
    closed = F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", F.lit(1), F.lit(1)))
    pair = ring.select(key, F.explode(F.arrays_zip(F.col("ring").alias("a"), closed.alias("b"))).alias("e"))
    return pair.select(key, F.col("e.a.x").alias("xa"), F.col("e.a.y").alias("ya"), F.col("e.b.x").alias("xb"), F.col("e.b.y").alias("yb")).filter("ya <> yb or xa <> xb")


#: Cells of a row that are held together where spans meet them.
SEGMENT = 256


def spans(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, r, c0, c1): runs of cells whose centre is inside, by scanlines: each row's crossings, sorted and paired."""
    e = edges(polygons, key, rings).filter("ya <> yb").selectExpr(key, "least(ya, yb) as lo", "greatest(ya, yb) as hi", "xa", "ya", "(xb - xa) / (yb - ya) as slope")
    # Row r is crossed when lo <= r + 0.5 < hi.
    rows = e.withColumn("first", F.ceil(F.col("lo") - 0.5)).withColumn("last", F.ceil(F.col("hi") - 0.5) - 1).filter("first <= last")
    hit = rows.select(key, F.explode(F.sequence("first", "last")).alias("r"), "xa", "ya", "slope").withColumn("x", F.col("xa") + (F.col("r") + 0.5 - F.col("ya")) * F.col("slope"))
    line = hit.groupBy(key, "r").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2)), lambda i: F.struct(F.ceil(F.element_at("xs", i) - 0.5).alias("c0"), (F.ceil(F.element_at("xs", i + 1) - 0.5) - 1).alias("c1")))
    return line.filter(F.size("xs") > 1).select(key, "r", F.explode(pairs).alias("s")).filter("s.c0 <= s.c1").select(key, "r", "s.c0", "s.c1")


def rasterize(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, r, c): cells whose centre is inside."""
    return spans(polygons, key, rings).select(key, "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def pieces(polygons: DataFrame, key: str, rings: str = "rings", size: int = SEGMENT) -> DataFrame:
    """(key, r, seg, c0, c1): spans cut where segments of rows end; a span over many cells is few rows."""
    k = lambda c: F.floor(F.col(c) / size)
    cut = spans(polygons, key, rings).select(key, "r", F.explode(F.sequence(k("c0"), k("c1"))).alias("seg"), "c0", "c1")
    return cut.withColumns({"c0": F.greatest("c0", F.col("seg") * size), "c1": F.least("c1", F.col("seg") * size + size - 1)})


def segments(cells: DataFrame, columns: list[str], by: list[str] = [], size: int = SEGMENT) -> DataFrame:  # noqa: B006
    """(by, r, seg, held): the cells (c, columns) of each segment of a row, by column."""
    return cells.withColumn("seg", F.floor(F.col("c") / size)).groupBy(*by, "r", "seg").agg(F.sort_array(F.collect_list(F.struct("c", *columns))).alias("held"))


def cells_in(polygons: DataFrame, key: str, cells: DataFrame, columns: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, key, r, c, columns): the cells of a raster that lie in polygons; spans meet segments, and only cells that are inside become rows."""
    met = pieces(polygons, key).join(segments(cells, columns, by), ["r", "seg"])
    found = met.select(*by, key, "r", F.explode(F.filter("held", lambda x: x["c"].between(F.col("c0"), F.col("c1")))).alias("x"))
    return found.select(*by, key, "r", "x.*")


def inside(x: Column, y: Column, rings: str) -> Column:
    """Whether a point is inside rings, by counting edges crossed to its right."""

    def crossings(ring: Column) -> Column:
        closed = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, F.lit(1), F.lit(1)))
        crossed = F.zip_with(ring, closed, lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0))
        return F.aggregate(crossed, F.lit(0), lambda acc, v: acc + v)

    return F.aggregate(F.col(rings), F.lit(0), lambda acc, ring: acc + crossings(ring)) % 2 == 1


def bbox(rings: str) -> dict[str, Column]:
    xs, ys = F.transform(F.flatten(rings), lambda p: p["x"]), F.transform(F.flatten(rings), lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, rings: str = "rings", cell: float = 16.0, most: int = 100_000) -> DataFrame:
    """points joined with the polygons that hold them: an equality join on adaptive cells, then the exact test."""
    box = bbox(rings)
    left = leaves.boxed(points, F.col("x"), F.col("y"), F.col("x"), F.col("y"))
    right = leaves.boxed(polygons.select(key, F.col(rings).alias("__rings")), *[bbox("__rings")[n] for n in box])
    met = leaves.joined(left, right, cell, most)
    return met.filter(inside(F.col("x"), F.col("y"), "__rings")).select(*points.columns, key)


def boxes_that_meet(left: DataFrame, right: DataFrame, cell: float = 0.5, most: int = 100_000) -> DataFrame:
    """(left_id, right_id) of boxes (id, west, south, east, north) that intersect.

    Equal boxes of a side are compared once.  A pair is reported from the one cell that holds its overlap's lower left corner, so no pair is seen twice.
    """
    sides = [leaves.boxed(df.select(F.col("id").alias(f"{n}_id"), "west", "south", "east", "north"), *map(F.col, ("west", "south", "east", "north"))) for df, n in ((left, "left"), (right, "right"))]
    return _pairs(_gathered_join(sides, ("left_id", "right_id"), [list(leaves.BOX)] * 2, cell, most), "left_id", "right_id")


def _gathered_join(sides: list[DataFrame], keys: tuple[str, str], shapes: list[list[str]], cell: float, most: int) -> DataFrame:
    """Pairs of lists of keys, of boxed sides whose shapes' boxes meet, each pair of shapes once a pair of lists.

    The keys of the side with more copies of a shape are the first column.  With enough copies for runs, its lists each go by with all that they meet
    in a cell, else those of the other side do.
    """
    lists = [leaves.gathered(s, k, shape) for s, k, shape in zip(sides, keys, shapes)]
    copies = [rows.agg(F.avg(F.size(k))).first()[0] or 0 for rows, k in zip(lists, keys)]
    fuller = int(copies[1] > copies[0])
    first = fuller if copies[fuller] >= leaves.RUN else 1 - fuller
    lists[first] = leaves.cut(lists[first], keys[first], leaves.FIRST_LIST)
    met = leaves.joined(*lists, cell, most, lists=keys, first=first).filter(leaves.at_corner(cell))
    return met.select(keys[fuller], *[n for n in met.columns if n != keys[fuller]])


def _pairs(met: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The pairs of keys of lists that met.

    For each key of the other list, the one that comes first among the columns is gone through.  While its turn lasts, it is one short sequence repeated
    beside runs of equal keys, so columnar files of the pairs take few bytes.
    """
    inner, outer = sorted((left_key, right_key), key=met.columns.index)
    # By a lambda, which is not compiled into one loop with the join: that loop would hold the pairs of a list with a whole cell in memory.
    one = F.explode(F.transform(outer, lambda k: k))
    return met.select(inner, one.alias(outer)).select(F.explode(inner).alias(inner), outer).select(left_key, right_key)


def within_distance(left: DataFrame, right: DataFrame, distance: float, most: int = 100_000) -> DataFrame:
    """(left_id, right_id, distance) of points (id, x, y) at most `distance` apart: a left point meets the cells about it, a right one its own.

    Cells are as wide as the distance and are not cut further; one with many rows is dealt by parts.
    """
    a = left.select(F.col("id").alias("left_id"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = right.select(F.col("id").alias("right_id"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    # A little wider than the distance, so that rounding hides no neighbour.
    d = distance * (1 + 1e-9)
    a = leaves.boxed(a, F.col("xa") - d, F.col("ya") - d, F.col("xa") + d, F.col("ya") + d)
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    met = leaves.joined(a, leaves.boxed(b, *map(F.col, ("xb", "yb", "xb", "yb"))), distance, most, levels=0)
    return met.withColumn("distance", F.sqrt(dx * dx + dy * dy)).filter(F.col("distance") <= distance).select("left_id", "right_id", "distance")


def ring_area(rings: str) -> Column:
    """Area by the shoelace rule, holes taken off."""

    def of(ring: Column) -> Column:
        closed = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, F.lit(1), F.lit(1)))
        return F.abs(F.aggregate(F.zip_with(ring, closed, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda acc, v: acc + v)) / 2

    areas = F.transform(rings, of)
    return 2 * F.element_at(areas, 1) - F.aggregate(areas, F.lit(0.0), lambda acc, v: acc + v)


def zonal_stats(zones: DataFrame, cells: DataFrame, key: str, value: str) -> DataFrame:
    """Per zone count, mean, min and max of the valid cells inside; empty zones count 0.

    Neither a polygon's cells nor pairs of a zone and a cell become rows: a segment of a row that a span covers whole answers with its sums, at
    the ends of a span the cells inside are added up where they are held.
    """
    v = cells.select("r", "c", F.col(value).cast("double").alias("v")).filter("v is not null")
    whole = segments(v, ["v"]).withColumns({"vs": F.transform("held", lambda x: x["v"]), "at": F.transform("held", lambda x: x["c"])})
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    whole = whole.select("r", "seg", "held", F.element_at("at", 1).alias("first"), F.element_at("at", -1).alias("last"), F.size("vs").alias("n"), total(F.col("vs")).alias("sum"), F.array_min("vs").alias("min"), F.array_max("vs").alias("max"))
    met = pieces(zones, key).join(whole, ["r", "seg"])
    full = (F.col("c0") <= F.col("first")) & (F.col("c1") >= F.col("last"))
    inner = F.when(~full, F.transform(F.filter("held", lambda x: x["c"].between(F.col("c0"), F.col("c1"))), lambda x: x["v"]))
    of = met.select(key, inner.alias("inner"), full.alias("full"), "n", "sum", "min", "max")
    either = lambda a, b: F.when(F.col("full"), F.col(a)).otherwise(b)
    parts = of.select(key, either("n", F.size("inner")).alias("n"), either("sum", total(F.col("inner"))).alias("sum"), either("min", F.array_min("inner")).alias("min"), either("max", F.array_max("inner")).alias("max"))
    got = parts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))
    got = got.select(key, "n", F.bround(F.try_divide("sum", "n"), 6).alias("mean"), "min", "max")
    return zones.select(key).join(got, key, "left").na.fill(0, ["n"])


def sample_at_points(points: DataFrame, cells: DataFrame, bands: list[str], x0: float = 0.0, y0: float = 0.0, size: float = 1.0) -> DataFrame:
    """Band values at points: the cell that holds each, null outside the raster."""
    at = points.withColumns({"r": F.floor((F.col("y") - y0) / size), "c": F.floor((F.col("x") - x0) / size)})
    return at.join(cells.select("r", "c", *bands), ["r", "c"], "left")


def sample_at_polygons(zones: DataFrame, cells: DataFrame, key: str, bands: list[str]) -> DataFrame:
    """(key, r, c, bands) of the cells inside whose bands are all valid."""
    return cells_in(zones, key, cells.dropna(subset=bands), bands)


def mosaic(layers: list[DataFrame]) -> DataFrame:
    """(r, c, value): where layers overlap, the later one that has data wins."""
    tagged = [x.select("r", "c", "value", F.lit(k).alias("layer")) for k, x in enumerate(layers)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.filter("value is not null").groupBy("r", "c").agg(F.max_by("value", "layer").alias("value"))


def zonal_series(zones: DataFrame, series: DataFrame, key: str, date: str = "t", value: str = "value") -> DataFrame:
    """(date, key, mean, median, sum, std) of a long series (date, r, c, value) over the cells of each zone; population deviation."""
    held = cells_in(zones, key, series.select(date, "r", "c", F.col(value).alias("__v")), ["__v"], [date])
    got = held.groupBy(date, key).agg(F.bround(F.avg("__v"), 6).alias("mean"), F.sum("__v").alias("sum"), F.bround(F.stddev_pop("__v"), 6).alias("std"))
    return got.join(quantiles(held, {"__m": ("__v", (0.5,))}, [date, key]), [date, key]).select(date, key, "mean", F.col("__m")[0].alias("median"), "sum", "std")


def overlay(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "intersection", within: DataFrame | None = None) -> DataFrame:
    """(r, c, left_key, right_key) of two polygon layers on cells: intersection, union (either may be null), or clip (left where any right is).

    `within` limits the result to cells (r, c).
    """
    kind = {"intersection": "inner", "union": "full_outer", "clip": "left_semi"}
    if how not in kind:
        raise ValueError(f"how must be one of {sorted(kind)}")
    a, b = rasterize(left, left_key), rasterize(right, right_key)
    if within is not None:
        a, b = (x.join(within.select("r", "c"), ["r", "c"], "left_semi") for x in (a, b))
    return a.join(b, ["r", "c"], kind[how])


def clip_points(points: DataFrame, polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """The points inside any polygon, each once, as they are."""
    numbered = points.withColumn("__row", F.monotonically_increasing_id())
    return points_in_polygons(numbered, polygons, key, rings).drop(key).dropDuplicates(["__row"]).drop("__row")


def _closed(ring: Column) -> Column:
    return F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, F.lit(1), F.lit(1)))


def _sides(rings: Column) -> Column:
    """All sides of all rings, as structs of two vertices a and b."""
    return F.flatten(F.transform(rings, lambda ring: F.zip_with(ring, _closed(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _on(p: Column, side: Column) -> Column:
    a, b = side["a"], side["b"]
    near = p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    return (_turn(a, b, p) == 0) & near


def _crossed(s: Column, t: Column) -> Column:
    """Whether two sides cross at an inner place of both."""
    return (_turn(s["a"], s["b"], t["a"]) * _turn(s["a"], s["b"], t["b"]) < 0) & (_turn(t["a"], t["b"], s["a"]) * _turn(t["a"], t["b"], s["b"]) < 0)


def _in_or_on(p: Column, sides: Column) -> Column:
    x, y = p["x"], p["y"]
    crossed = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    return (F.size(F.filter(sides, crossed)) % 2 == 1) | F.exists(sides, lambda s: _on(p, s))


def polygons_meet(left: Column, right: Column, predicate: str = "intersects") -> Column:
    """Whether polygons (rings) intersect (touching counts), the left is within the right, or contains it.

    within: no side crosses, and every vertex and every middle of a side is in the other or on its edge.
    """
    if predicate == "contains":
        return polygons_meet(right, left, "within")
    if predicate not in ("intersects", "within"):
        raise ValueError("predicate must be intersects, within or contains")
    middle = lambda s: F.struct(((s["a"]["x"] + s["b"]["x"]) / 2).alias("x"), ((s["a"]["y"] + s["b"]["y"]) / 2).alias("y"))

    def test(a: Column, b: Column) -> Column:
        cross = F.exists(a, lambda s: F.exists(b, lambda t: _crossed(s, t)))
        if predicate == "within":
            return F.forall(a, lambda s: _in_or_on(s["a"], b) & _in_or_on(middle(s), b)) & ~cross
        return F.exists(a, lambda s: _in_or_on(s["a"], b)) | F.exists(b, lambda s: _in_or_on(s["a"], a)) | cross

    # The sides are made once for a pair, as one-element arrays that lambdas take.
    return F.transform(F.array(_sides(left)), lambda a: F.transform(F.array(_sides(right)), lambda b: test(a, b))[0])[0]


def is_box(rings: Column) -> Column:
    """Whether rings are one ring of the four corners of a box with sides along the axes, in their order; the first may stand again at the end."""

    def corners(p: list[Column]) -> Column:
        apart = lambda a, b: (a["x"] != b["x"]) & (a["y"] != b["y"])
        held = lambda v: v["x"].isin(p[0]["x"], p[2]["x"]) & v["y"].isin(p[0]["y"], p[2]["y"])
        return apart(p[0], p[2]) & apart(p[1], p[3]) & held(p[1]) & held(p[3])

    ring = F.get(rings, 0)
    n, p = F.size(ring), [F.get(ring, i) for i in range(5)]
    closed = (n == 4) | ((n == 5) & (p[0]["x"] == p[4]["x"]) & (p[0]["y"] == p[4]["y"]))
    return F.coalesce((F.size(rings) == 1) & closed & corners(p[:4]), F.lit(False))


def _as_rings(box: list[Column]) -> Column:
    """The rings of a box (xmin, ymin, xmax, ymax)."""
    west, south, east, north = box
    v = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(F.array(v(west, south), v(east, south), v(east, north), v(west, north)))


def _boxed_in(a: list[Column], b: list[Column]) -> Column:
    return (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])


def spatial_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", predicate: str = "intersects", cell: float = 0.5, most: int = 100_000) -> DataFrame:
    """(left_key, right_key) of polygon layers with rings: pairs for which the predicate holds, and with how = left or right the
    features without a partner once with null.

    Candidates come from an equality join on adaptive cells of the boxes; a pair is tested in the one cell that holds its boxes' overlap's
    lower left corner.  `cell` should be about the size of a usual box; cells with more than `most` rows are cut.  Features of equal rings are
    tested once, and those that are boxes are compared by their ends alone.
    """
    if how not in ("inner", "left", "right"):
        raise ValueError("how must be inner, left or right")

    def shaped(df: DataFrame, key: str, side: str) -> DataFrame:
        df = df.select(F.col(key).alias(f"{side}_key"), F.col("rings").alias(f"{side}_rings"))
        df = leaves.with_box(df, *[bbox(f"{side}_rings")[n] for n in ("xmin", "ymin", "xmax", "ymax")])
        # Boxes travel without their rings.
        return df.withColumn(f"{side}_rings", F.when(~is_box(F.col(f"{side}_rings")), F.col(f"{side}_rings")))

    rows = [shaped(left, left_key, "l"), shaped(right, right_key, "r")]
    shapes = [[*leaves.BOX, f"{side}_rings"] for side in "lr"]
    met = _gathered_join([r.dropna(subset=list(leaves.BOX)) for r in rows], ("l_key", "r_key"), shapes, cell, most)
    a, b = ([F.col(f"__{side}{n}") for n in ("xmin", "ymin", "xmax", "ymax")] for side in ("", "r_"))
    inner = {"within": _boxed_in(a, b), "contains": _boxed_in(b, a)}.get(predicate, F.lit(True))
    rings = [F.coalesce(F.col(f"{side}_rings"), _as_rings(box)) for side, box in (("l", a), ("r", b))]
    # The box of what lies within a polygon lies within its box; of two boxes nothing else is to be tested.
    met = met.filter(inner & F.when(F.col("l_rings").isNull() & F.col("r_rings").isNull(), F.lit(True)).otherwise(polygons_meet(*rings, predicate)))
    pairs = _pairs(met, "l_key", "r_key").toDF(left_key, right_key)
    if how == "inner":
        return pairs
    # Shapes with a partner are found without their pairs; a feature whose shape is not among them has none.
    own = int(how == "right")
    found = met.select(*[c.alias(f"__found{k}") for k, c in enumerate([*(b if own else a), F.col(shapes[own][-1])])]).distinct()
    same = [F.col(n).eqNullSafe(F.col(f"__found{k}")) for k, n in enumerate(shapes[own])]
    alone = rows[own].join(found, reduce(and_, same), "left_anti")
    none = F.lit(None).cast(pairs.schema[left_key if own else right_key].dataType)
    keys = [none, F.col("r_key")] if own else [F.col("l_key"), none]
    return pairs.union(alone.select(*keys))
