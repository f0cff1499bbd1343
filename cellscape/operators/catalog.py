"""Operators on raster and scene catalogs: roles, grids, search, ranking, reports and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellscape.functions import catalog as fn


def infer_roles(labels: DataFrame) -> DataFrame:
    """(role, status, bands): found, ambiguous or missing for every known role; labels has (band, role)."""
    spark = labels.sparkSession
    roles = spark.createDataFrame([(r,) for r in fn.ROLES], "role string")
    got = labels.filter("role is not null").groupBy("role").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    n = F.size("bands")
    return roles.join(got, "role", "left").select("role", F.when(F.col("bands").isNull(), "missing").when(n == 1, "found").otherwise("ambiguous").alias("status"), F.coalesce("bands", F.array().cast(dict(got.dtypes)["bands"])).alias("bands"))


def band_at(bands: DataFrame, nm: float, tol: float = 15.0) -> int:
    """The number of the band nearest to nm; an error beyond tol."""
    row = bands.filter("wl_nm is not null").agg(F.min_by("band", F.struct(F.abs(F.col("wl_nm") - nm), F.col("band"))), F.min(F.abs(F.col("wl_nm") - nm))).first()
    if row[0] is None or row[1] > tol:
        raise ValueError(f"no band within {tol} nm of {nm}")
    return row[0]


def same_grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (left, right, same): srid and shape equal, six transform terms within 1e-6; a and b joined by the caller's `pair`."""
    close = lambda k: F.abs(F.col(f"a.{k}") - F.col(f"b.{k}")) <= 1e-6
    same = (F.col("a.srid") == F.col("b.srid")) & (F.col("a.width") == F.col("b.width")) & (F.col("a.height") == F.col("b.height"))
    for k in ("dx", "dy", "x0", "y0"):
        same = same & close(k)
    return a.alias("a").join(b.alias("b"), "pair").select(F.col("a.raster_id").alias("left"), F.col("b.raster_id").alias("right"), same.alias("same"))


def alignment_report(rasters: DataFrame, tol: float = 1e-6) -> DataFrame:
    """How every raster's grid differs from the first one's."""
    first = F.broadcast(rasters.orderBy("raster_id").limit(1).select(*[F.col(k).alias(f"f_{k}") for k in ("srid", "width", "height", "dx", "dy", "x0", "y0")]))
    j = rasters.crossJoin(first)
    off = lambda *ks: F.greatest(*[F.abs(F.col(k) - F.col(f"f_{k}")) for k in ks]) > tol
    differs = F.array(
        F.when(F.col("srid") != F.col("f_srid"), "crs"),
        F.when(off("dx", "dy"), "resolution"),
        F.when((F.col("width") != F.col("f_width")) | (F.col("height") != F.col("f_height")), "size"),
        F.when(off("x0", "y0"), "bounds"),
    )
    return j.select("raster_id", F.array_compact(differs).alias("differs"))


def order_by_date(scenes: DataFrame, keys: list[str]) -> DataFrame:
    """Scenes with their date (the first readable of the key columns) and `place`, 1 for the oldest and the same for equal dates; a scene
    without a date is an error.  Places are counted over the dates, of which there are few, not over the scenes."""
    date = F.coalesce(*[F.try_to_timestamp(F.col(k)) for k in keys])
    dated = scenes.withColumn("acquired", date)
    dated = dated.withColumn("acquired", F.when(F.col("acquired").isNull(), F.raise_error(F.lit("no acquisition date")).cast("timestamp")).otherwise(F.col("acquired")))
    dates = dated.groupBy("acquired").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("acquired").rowsBetween(W.unboundedPreceding, -1))
    return dated.join(dates.select("acquired", (F.coalesce(before, F.lit(0)) + 1).cast("int").alias("place")), "acquired")


def search_scenes(items: DataFrame, box: tuple[float, float, float, float], start: str, end: str, most_cloud: float = 100.0) -> DataFrame:
    """Items of the period with their coverage of the box, by `footprint` (rings) where that column is there and not null; cloud at most most_cloud, and
    for Sentinel-2 no-data at most 20."""
    found = items.filter((F.col("dt") >= F.lit(start).cast("date")) & (F.col("dt") <= F.lit(end).cast("date")))
    found = found.filter(F.col("cloud").isNull() | (F.col("cloud") <= most_cloud)).filter((F.col("collection") != "sentinel-2-l2a") | (F.col("nodata_pct") <= 20))
    return found.withColumn("coverage", fn.coverage_pct(box, F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("footprint") if "footprint" in items.columns else None))


def rank_scenes(found: DataFrame, limit: int = 12) -> DataFrame:
    """The best `limit` scenes: coverage down (missing 50), cloud up (missing 50), no-data up (missing 0), then id."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1..100")
    return found.orderBy(F.coalesce("coverage", F.lit(50.0)).desc(), F.coalesce("cloud", F.lit(50.0)), F.coalesce("nodata_pct", F.lit(0.0)), "item_id").limit(limit)


def coverage_gate(found: DataFrame, least: float = 50.0, box: tuple[float, float, float, float] | None = None, coarse: tuple[str, ...] = ("landsat-c2-l2",)) -> DataFrame:
    """Whether each scene may be used: covering at least `least` percent, or not alone on its date.

    With a box (west, south, east, north), no scene is accepted if the box's native grid has more cells than can be held: cells of 30 m if all
    scenes are of `coarse` collections, else of 10 m.
    """
    alone = F.count("*").over(W.partitionBy("dt")) == 1
    out = found.withColumn("accepted", ~((F.col("coverage") < least) & alone))
    if box is None:
        return out
    grid = fn.native_grid(*[F.lit(float(x)) for x in box], F.col("__coarse"))["within_limit"]
    fits = found.agg(F.coalesce(F.bool_and(F.col("collection").isin(*coarse)), F.lit(False)).alias("__coarse")).select(grid.alias("__fits"))
    return out.crossJoin(F.broadcast(fits)).withColumn("accepted", F.col("accepted") & F.col("__fits")).drop("__fits")


def required_assets(items: DataFrame) -> DataFrame:
    """Requested assets first, then those the collection needs, without repeats, as far as the item has them."""
    needs = F.create_map(*[x for k, v in fn.REQUIRED_ASSETS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wanted = F.array_distinct(F.concat("requested", F.coalesce(needs[F.col("collection")], F.array(*map(F.lit, ("B04", "B03", "B02", "B08"))))))
    return items.withColumn("assets", F.filter(wanted, lambda a: F.array_contains("has", a)))


# Kinds of places and how far each moves a place's score; the first that holds counts.
PLACE_SHIFTS = (
    ("cls", ("highway", "building", "shop", "amenity", "office", "craft"), -10.0),
    ("typ", ("house", "apartments", "residential", "street", "road", "service", "parking"), -8.0),
    ("cls", ("natural", "place", "boundary", "geological", "waterway", "landuse", "historic"), 5.0),
)
# Points of a raster for a deliverable, words that mean a change, months, ends of a map's name, and words of a stem that say nothing.
STEM_POINTS = {"same": 200, "date": 100, "change": 60, "year": 40, "month": 30, "word": 10}
CHANGE_WORDS = ("change", "diff", "transition", "loss", "gain", "comparison")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MAP_ENDS = ("_map", "_plot", "_viz", "_output", "_result", "_classified")
EMPTY_WORDS = ("tif", "tiff", "png", "frame", "water", "mask", "aral")


def place_score() -> Column:
    """Importance and the shift of a place's kind."""
    shift = F.coalesce(*[F.when(F.lower(column).isin(*words), points) for column, words, points in PLACE_SHIFTS], F.lit(0.0))
    return F.coalesce("importance", F.lit(0.0)) + shift


def rank_places(gazetteer: DataFrame) -> DataFrame:
    """Per query the best place and its box: wide boxes shrink to 0.15 degrees about the centre, tiny ones grow to 0.08."""
    best = gazetteer.withColumn("score", place_score()).withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "place_id"))).filter("n = 1")
    wide = (F.col("east") - F.col("west") > 0.45) | (F.col("north") - F.col("south") > 0.45)
    tiny = (F.col("east") - F.col("west") < 0.02) | (F.col("north") - F.col("south") < 0.02)
    half = F.when(F.col("west").isNull(), 0.12).when(wide, 0.15).when(tiny, 0.08)
    side = lambda edge, centre, sign: F.bround(F.coalesce(F.col(centre) + sign * half, F.col(edge)), 5).alias(edge)
    return best.select("query", "place_id", "score", side("west", "lon", -1), side("south", "lat", -1), side("east", "lon", 1), side("north", "lat", 1))


def _stem(x: Column) -> dict[str, Column]:
    """What a lower-case file stem says: its names (itself, and without a map's ending), dates (with their months), years, words, change."""
    dates = F.transform(F.regexp_extract_all(x, F.lit(r"(?<!\d)\d{4}[-_]\d{2}(?:[-_]\d{2})?(?!\d)"), F.lit(0)), lambda d: F.translate(d, "_", "-"))
    return {
        "names": F.array_distinct(F.array(x, F.regexp_replace(x, f"({'|'.join(MAP_ENDS)})$", ""))),
        "dates": F.array_distinct(F.concat(dates, F.transform(dates, lambda d: F.substring(d, 1, 7)))),
        "years": F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?<!\d)(?:19|20)\d{2}(?!\d)"), F.lit(0))),
        "words": F.array_except(F.split(x, "[-_.]+"), F.array(*map(F.lit, EMPTY_WORDS))),
        "change": x.rlike("|".join(CHANGE_WORDS)),
    }


def _months(x: Column, numbers: bool) -> Column:
    """Months (1..12) that a stem names, or has as a number after a dash."""
    holds = lambda m: x.contains(MONTHS[m]) | (F.translate(x, "_", "-").contains(f"-{m + 1:02}") if numbers else F.lit(False))
    return F.array_compact(F.array(*[F.when(holds(m), F.lit(m + 1)) for m in range(12)]))


def match_rasters(targets: DataFrame, rasters: DataFrame, top: int = 3, context: tuple[str, ...] = (), most: int = 1000) -> DataFrame:
    """(target, raster, points, place): per deliverable the `top` rasters by file stem, of those with any points; equal points by name.

    Points are for the same name (but for a map's ending), a date, a year, months, change on both sides (or in the words of `context`) and shared words.
    Candidates come from equality joins on those signs.  A sign of more than `most` rasters makes no pairs: rasters are grouped by the frequent
    signs they bear, and the first `top` of each group stand for it, since all others of it score no more unless a rarer sign is shared.
    """
    t, r, changes = F.lower("target"), F.lower("raster"), any(w in c.lower() for c in context for w in CHANGE_WORDS)
    of = lambda x, c: (_stem(x), F.when(F.lit(c) | x.rlike("|".join(CHANGE_WORDS)), F.array(F.lit("change"))).otherwise(F.array().cast("array<string>")))
    (ts, tc), (rs, rc) = of(t, changes), of(r, False)

    def keyed(df: DataFrame, name: str, s: dict, months: Column, change: Column) -> DataFrame:
        parts = [F.transform(s[k], _prefixed(k)) for k in ("names", "dates", "years", "words")]
        return df.select(name, F.explode(F.array_distinct(F.concat(*parts, F.transform(months, _prefixed("month")), change))).alias("sign"))

    tt = keyed(targets.select("target").distinct(), "target", ts, _months(t, False), tc)
    rr = keyed(rasters.select("raster").distinct(), "raster", rs, _months(r, True), rc)
    frequent = rr.groupBy("sign").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("sign")
    rare = tt.join(rr.join(frequent, "sign", "left_anti"), "sign").select("target", "raster")
    groups = rr.join(frequent, "sign").groupBy("raster").agg(F.sort_array(F.collect_set("sign")).alias("signs"))
    first = groups.withColumn("k", F.row_number().over(W.partitionBy("signs").orderBy("raster"))).filter(F.col("k") <= top).select("signs", "raster")
    by_sign = first.select("signs").distinct().select("signs", F.explode("signs").alias("sign"))
    common = tt.join(by_sign, "sign").select("target", "signs").distinct().join(first, "signs").select("target", "raster")
    overlap = lambda k: F.arrays_overlap(ts[k], rs[k])
    points = F.size(F.array_intersect(ts["words"], rs["words"])) * STEM_POINTS["word"] + F.size(F.array_intersect(_months(t, False), _months(r, True))) * STEM_POINTS["month"]
    for name, holds in {"same": F.array_contains(ts["names"], r) | F.array_contains(rs["names"], t), "date": overlap("dates"), "year": overlap("years"), "change": (F.lit(changes) | ts["change"]) & rs["change"]}.items():
        points = points + F.when(holds, STEM_POINTS[name]).otherwise(0)
    pairs = rare.union(common).distinct().withColumn("points", points).filter("points > 0")
    return pairs.withColumn("place", F.row_number().over(W.partitionBy("target").orderBy(F.desc("points"), "raster"))).filter(F.col("place") <= top)


def _prefixed(kind: str):
    return lambda v: F.concat(F.lit(f"{kind}:"), v.cast("string"))


def raster_summary(cells: DataFrame, bands: list[str], step: int = 1) -> DataFrame:
    """(band, n, min, max, mean) of each band over every step-th row and column; all bands in one pass."""
    kept = cells.filter((F.col("r") % step == 0) & (F.col("c") % step == 0))
    long = kept.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands])).alias("x")).select("x.*")
    return long.groupBy("band").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.bround(F.avg("v"), 6).alias("mean"))


def tile_grid(images: DataFrame, rows: int, cols: int) -> DataFrame:
    """rows x cols tiles (1..6 each) of every image (image_id, west, south, east, north): ids and boxes, row 0 north."""
    if not (1 <= rows <= 6 and 1 <= cols <= 6):
        raise ValueError("rows and cols must be 1..6")
    t = images.withColumn("tr", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("tc", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    w, h = F.col("east") - F.col("west"), F.col("north") - F.col("south")
    return t.select(
        "image_id", F.format_string("T%d_%d", "tr", "tc").alias("tile"),
        (F.col("west") + w * F.col("tc") / cols).alias("west"), (F.col("north") - h * (F.col("tr") + 1) / rows).alias("south"),
        (F.col("west") + w * (F.col("tc") + 1) / cols).alias("east"), (F.col("north") - h * F.col("tr") / rows).alias("north"),
    )


def probed_gaps(bands: list[str]) -> Column:
    """The share of missing cells by which a raster is judged: that of its first band, or where over 95 % of it is missing, the lowest of it and the
    bands at a quarter, half, three quarters and the end, taken in turn until half of one is there."""
    gap = lambda b: F.count_if(F.col(b).isNull()) / F.count("*")
    n = len(bands)
    probes = [bands[k - 1] for k in sorted({n // 4, n // 2, 3 * n // 4, n}) if 1 < k <= n]

    def take(best: Column, x: Column) -> Column:
        return F.when((best > 0.95) | (best > 0.50), F.least(best, x)).otherwise(best)

    first = gap(bands[0])
    return F.when(first > 0.95, F.aggregate(F.array(*map(gap, probes)), first, take)).otherwise(first) if probes else first


def raster_quality(cells: DataFrame, band: str | list[str], method: str, no_data_limit: float = 0.60, cloud_limit: float = 0.70, geographic: bool = False) -> DataFrame:
    """One row: no-data and cloud share, warnings, and whether the raster has enough data.  With several bands (in their order) no-data is that of
    `probed_gaps`, and cloud is judged where the first is there; a `geographic` system is a warning."""
    from cellscape.operators.cells import cloud_flag

    bands = [band] if isinstance(band, str) else list(band)
    cloud = F.coalesce(F.try_divide(F.count_if(cloud_flag(method) & F.col(bands[0]).isNotNull()).cast("double"), F.count(bands[0])), F.lit(0.0))
    q = cells.agg(F.bround(probed_gaps(bands), 4).alias("nodata"), F.bround(cloud, 4).alias("cloud"))
    verdict = F.when((F.col("nodata") >= no_data_limit) | (F.col("cloud") >= cloud_limit), "insufficient_data").otherwise("ok")
    warnings = F.array_join(F.array_compact(F.array(F.when(F.col("nodata") > 0.20, "no-data"), F.when(F.col("cloud") > 0.30, "cloud"), F.when(F.lit(geographic), "geographic"))), ",")
    return q.select("nodata", "cloud", warnings.alias("warnings"), verdict.alias("verdict"))
