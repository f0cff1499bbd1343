"""Grid cells for spatial joins that adapt to where the rows are.

Rows of both sides (boxes; a point is a box without extent) are dealt to square cells.  Cells with more rows than a bound are cut into
SPLIT x SPLIT smaller ones, again and again, so a city in a wide table is many keys, and its small boxes meet few others.  What is still too
full at the last level (rows at one place) is dealt by parts: the larger side by a hash of the row, the smaller one to every part.

The bound is at least a 65,536th of all rows, so the tables of full cells that are broadcast have at most that many rows a level.

Where nearly every row has partners, rows of equal shape are gathered first: copies are tested once, and pairs of lists become pairs of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.sources.scratch import stored

SPLIT, LEVELS, MOST_FULL = 8, 3, 65_536
#: Keys in a list of copies; and in one of the side whose lists each go by with all that they meet in a cell.
LIST, FIRST_LIST = 1_024, 64
#: From so many equal values on, files keep a run and not the values.
RUN = 8
KEYS = ["__level", "__gx", "__gy", "__part"]
_CELL = KEYS[:3]
BOX = ("__xmin", "__ymin", "__xmax", "__ymax")


def with_box(rows: DataFrame, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> DataFrame:
    """rows with their box in columns of its own."""
    return rows.withColumns({n: c.cast("double") for n, c in zip(BOX, (xmin, ymin, xmax, ymax))})


def boxed(rows: DataFrame, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> DataFrame:
    """rows with their box in columns of its own; rows with a missing coordinate meet nothing and are left out."""
    return with_box(rows, xmin, ymin, xmax, ymax).dropna(subset=list(BOX))


def gathered(rows: DataFrame, key: str, shape: list[str], held: int = LIST, most: int = LIST) -> DataFrame:
    """(shape, key): the rows of equal shape as one row with the list of their keys, stored; lists are cut to `held` keys.

    A shape with more than `most` rows, or a 65,536th of all rows if that is more, is dealt by a hash of the key, so no group grows with the table's
    largest number of copies.
    """
    # Shapes by their hash: two that share one are dealt to more lists than they need.
    counts = rows.groupBy(F.xxhash64(*shape).alias("__shape")).count()
    total, largest = counts.agg(F.sum("count"), F.max("count")).first()
    most = max(most, -(-(total or 0) // MOST_FULL))
    if (largest or 0) <= most:
        dealt = rows.withColumn("__list", F.lit(0))
    else:
        many = stored(counts.filter(F.col("count") > most).select("__shape", F.ceil(F.col("count") / most).cast("int").alias("__lists")))
        dealt = rows.withColumn("__shape", F.xxhash64(*shape)).join(F.broadcast(many), "__shape", "left")
        dealt = dealt.withColumn("__list", F.coalesce(F.pmod(F.xxhash64(key), "__lists").cast("int"), F.lit(0)))
    # Sorted, so that a task that runs again cuts as before; null keys are rows too.
    lists = dealt.groupBy(*shape, "__list").agg(F.sort_array(F.collect_list(key)).alias("__keys"), F.count_if(F.col(key).isNull()).cast("int").alias("__nulls"))
    lists = lists.select(*shape, F.concat("__keys", F.array_repeat(F.lit(None).cast(rows.schema[key].dataType), F.col("__nulls"))).alias("__keys"))
    return stored(cut(lists.select(*shape, F.col("__keys").alias(key)), key, held))


def cut(lists: DataFrame, key: str, held: int) -> DataFrame:
    """lists with those of more than `held` keys cut to that many."""
    pieces = F.transform(F.sequence(F.lit(1), F.size(key), F.lit(held)), lambda i: F.slice(key, i, F.lit(held)))
    return lists.withColumn(key, F.explode(pieces))


def _cover(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _spread(rows: DataFrame, cell: float) -> DataFrame:
    wide = rows.withColumns({"__level": F.lit(0), "__gx": F.explode(_cover(F.col("__xmin"), F.col("__xmax"), cell))})
    return wide.withColumn("__gy", F.explode(_cover(F.col("__ymin"), F.col("__ymax"), cell)))


def _deepened(rows: DataFrame, full: DataFrame, level: int, cell: float) -> DataFrame:
    """rows of full cells of a level in the smaller cells that their boxes touch."""
    size = cell / SPLIT ** (level + 1)

    def kids(g: str, low: str, high: str) -> Column:
        first, last = F.col(g) * SPLIT, F.col(g) * SPLIT + SPLIT - 1
        return F.explode(F.when(F.col("__full"), F.sequence(F.greatest(first, F.floor(F.col(low) / size)), F.least(last, F.floor(F.col(high) / size)))).otherwise(F.array(g)))

    flagged = rows.join(F.broadcast(full.select(*_CELL, F.lit(True).alias("__full"))), _CELL, "left")
    out = flagged.withColumn("__gx", kids("__gx", "__xmin", "__xmax")).withColumn("__gy", kids("__gy", "__ymin", "__ymax"))
    return out.withColumn("__level", F.when(F.col("__full"), level + 1).otherwise(F.col("__level"))).drop("__full")


def joined(left: DataFrame, right: DataFrame, cell: float, most: int = 100_000, levels: int = LEVELS, lists: tuple[str, str] | None = None, first: int = 0) -> DataFrame:
    """Rows of two boxed sides that share a cell, with the cell in `__level, __gx, __gy`; columns of both sides must differ but for the box's.

    The left side's box is in __xmin.. of the result, the right one's in __r_xmin...  A pair may meet in several cells: see `at_corner`.
    `lists` names the columns of keys of gathered sides: a row counts as its keys, and both sides are dealt to tasks by cell, about `most` keys a
    task, however small they are against their pairs.  Each row of side `first` then meets all of its cell in a row.
    """
    sides = [_spread(left, cell), _spread(right, cell)]
    weights = [F.size(n) for n in lists] if lists else [F.lit(1), F.lit(1)]
    counted, total = sides, 0
    for level in range(levels + 1):
        tally = [s.filter(F.col("__level") == level).select(*_CELL, *[weights[k].alias(n) if k == own else F.lit(0).alias(n) for own, n in enumerate("lr")]) for k, s in enumerate(counted)]
        counts = tally[0].union(tally[1]).groupBy(*_CELL).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        if level == 0:
            counts = stored(counts)
            total = counts.agg(F.sum(F.col("l") + F.col("r"))).first()[0] or 0
            most = max(most, -(-total // MOST_FULL))
        # A cell needs rows of both sides to give pairs.
        full = stored(counts.filter((F.col("l") + F.col("r") > most) & (F.col("l") > 0) & (F.col("r") > 0)))
        if full.isEmpty():
            break
        if level == levels:
            parts = F.ceil(F.greatest("l", "r") / F.lit(most)).cast("int")
            return _met(sides, cell, full.select(*_CELL, parts.alias("__parts"), (F.col("l") >= F.col("r")).alias("__left")), lists and -(-total // most), first)
        sides = [_deepened(s, full, level, cell) for s in sides]
        counted = [_deepened(s.join(F.broadcast(full.select(*_CELL)), _CELL, "left_semi"), full, level, cell) for s in counted]
    return _met(sides, cell, None, lists and -(-total // most), first)


def _met(sides: list[DataFrame], cell: float, salts: DataFrame | None, tasks: int | None, first: int) -> DataFrame:
    out = []
    for k, s in enumerate(sides):
        if salts is None:
            s = s.withColumn("__part", F.lit(0))
        else:
            s = s.join(F.broadcast(salts), _CELL, "left")
            # By the row itself, so that a task that runs again deals as before.
            one = F.array(F.pmod(F.xxhash64(*[c for c in s.columns if c not in (*_CELL, "__parts", "__left")]), F.col("__parts")).cast("int"))
            every = F.sequence(F.lit(0), F.col("__parts") - 1)
            own = F.col("__left") if k == 0 else ~F.col("__left")
            s = s.withColumn("__part", F.explode(F.when(F.col("__parts").isNull(), F.array(F.lit(0))).when(own, one).otherwise(every))).drop("__parts", "__left")
        size = _size(cell)
        out.append(s.withColumns({"__x_here": F.floor(F.col("__xmin") / size) == F.col("__gx"), "__y_here": F.floor(F.col("__ymin") / size) == F.col("__gy")}))
    right = out[1].withColumnsRenamed({n: n.replace("__", "__r_", 1) for n in (*BOX, "__x_here", "__y_here")})
    if tasks is None:
        return out[0].join(right, KEYS)
    spark = right.sparkSession
    # A number of tasks that is not lowered to what the sides' bytes need.
    tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # Without columns that may be constant: the join would shuffle again.
    by = KEYS[1:] if salts is not None else KEYS[1:3]
    one, other = (s.repartition(tasks, *by) for s in ((right, out[0]) if first else (out[0], right)))
    # A merge join takes the rows of its first side one by one, each with all of the other that it meets.
    return one.join(other.hint("merge"), KEYS)


def _size(cell: float) -> Column:
    """The width of a row's cell."""
    sizes = F.when(F.col("__level") == 0, F.lit(float(cell)))
    for level in range(1, LEVELS + 2):
        sizes = sizes.when(F.col("__level") == level, F.lit(float(cell) / SPLIT**level))
    return sizes


def at_corner(cell: float) -> Column:  # noqa: ARG001  the cell's size is already in the rows that met
    """Whether a pair's boxes meet, and the lower left corner of their overlap is in the pair's cell: true in one cell of each pair that meets.

    The corner is in the cell where the later of the two boxes begins, along each axis; which rows begin in their cell is known before they meet.
    """
    meet = (F.col("__xmin") <= F.col("__r_xmax")) & (F.col("__r_xmin") <= F.col("__xmax")) & (F.col("__ymin") <= F.col("__r_ymax")) & (F.col("__r_ymin") <= F.col("__ymax"))
    return (F.col("__x_here") | F.col("__r_x_here")) & (F.col("__y_here") | F.col("__r_y_here")) & meet
