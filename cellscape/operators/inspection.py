"""Reports on rasters, layers, point clouds, files and scenes: what is there, in which system, and whether it can be used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellscape.functions import catalog as fn
from cellscape.operators.grids import to_lonlat
from cellscape.operators.quantiles import quantiles
from cellscape.operators.ranks import ranked

# Tag names that hold wavelengths and their unit, kinds of files by ending, names of class tables, and how many bands a report lists.
LIST_TAGS = ("wavelengths", "WAVELENGTHS", "wavelength", "WAVELENGTH", "center_wavelengths")
UNIT_TAGS = ("wavelength_unit", "WAVELENGTH_UNIT", "wavelength units", "WAVELENGTH_UNITS")
BAND_TAGS = ("wavelength", "WAVELENGTH", "center_wavelength", "CENTER_WAVELENGTH", "wavelength_nm", "WAVELENGTH_NM", "wavelength_um", "WAVELENGTH_UM")
UNITS = {"nm": 1.0, "nanometer": 1.0, "nanometers": 1.0, "um": 1000.0, "µm": 1000.0, "micron": 1000.0, "microns": 1000.0, "micrometer": 1000.0, "micrometers": 1000.0}
FILE_KINDS = {"raster": ("tif", "tiff"), "lidar": ("las", "laz", "csv", "xyz", "txt"), "vector": ("geojson", "json", "gpkg", "shp"), "image": ("png", "jpg", "jpeg")}
CLASS_TAGS = ("classes", "CLASSES", "class_map", "CLASS_MAP", "class_names", "CLASS_NAMES", "labels", "LABELS", "legend", "LEGEND")
MOST_BANDS = 10


def _first_tag(tags: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(tags[n], F.lit("")) for n in names])


def band_wavelengths(bands: DataFrame, allow_missing: bool = False) -> DataFrame:
    """(raster_id, band, nm, source) of bands (raster_id, band, description, tags, band_tags): from the raster's list if it has one number a band,
    else the band's own tags, else its description.

    source: explicit_unit, assumed_nm or assumed_um.  A band without a wavelength is an error unless `allow_missing`.
    """
    number = r"(\d+(?:\.\d+)?)\s*((?i:nm|nanometers?|um|µm|microns?|micrometers?))?"
    listed = F.filter(F.split(F.btrim(_first_tag(F.col("tags"), LIST_TAGS), F.lit("{}[] ")), r"[,\s;]+"), lambda p: p != "")
    count = F.count("*").over(W.partitionBy("raster_id"))
    own = F.coalesce(*[F.when(F.col("band_tags")[k].isNotNull(), F.when(F.regexp_extract(F.col("band_tags")[k], number, 2) != "", F.col("band_tags")[k]).otherwise(F.concat(F.col("band_tags")[k], F.lit(f" {k[-2:].lower()}" if k.lower().endswith(("_um", "_nm")) else "")))) for k in BAND_TAGS])
    text = F.coalesce(F.when(F.size(listed) == count, F.get(listed, F.col("band") - 1)), own, F.col("description"))
    got = bands.withColumns({"__text": text, "__unit": _first_tag(F.col("tags"), UNIT_TAGS)})
    v = F.nullif(F.regexp_extract("__text", number, 1), F.lit("")).cast("double")
    unit = F.lower(F.trim(F.coalesce(F.nullif(F.regexp_extract("__text", number, 2), F.lit("")), F.col("__unit"))))
    scale = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])[unit]
    nm = F.when(scale.isNotNull(), v * scale).when(v.between(300.0, 2600.0), v).when(v.between(0.3, 2.6), v * 1000.0)
    source = F.when(nm.isNull(), None).when(scale.isNotNull(), "explicit_unit").when(v.between(300.0, 2600.0), "assumed_nm").otherwise("assumed_um")
    if not allow_missing:
        nm = F.when(nm.isNull(), F.raise_error(F.concat(F.lit("no wavelength of band "), F.col("band").cast("string"))).cast("double")).otherwise(nm)
    return got.select("raster_id", "band", nm.alias("nm"), source.alias("source"))


def wavelength_source(found: DataFrame) -> DataFrame:
    """(raster_id, source): the weakest of a raster's sources."""
    has = lambda s: F.bool_or(F.col("source") == s)
    return found.groupBy("raster_id").agg(F.when(has("assumed_um"), "assumed_um").when(has("assumed_nm"), "assumed_nm").otherwise("explicit_unit").alias("source"))


def spectral_summary(bands: DataFrame, wl: str = "wl_nm") -> DataFrame:
    """One row: how many wavelengths, their ends, the median step to the next, good ones, and whether there are enough for a spectrum.

    Bands are numbered by two-level ranks, so a table of many instruments is many tasks.
    """
    known = bands.filter(F.col(wl).isNotNull()).select(F.col(wl).cast("double").alias("nm"))
    numbered = ranked(known, [], F.floor(F.col("nm") / 8), [F.col("nm")], "k")
    step = numbered.alias("a").join(numbered.alias("b"), F.col("b.k") == F.col("a.k") + 1).select((F.col("b.nm") - F.col("a.nm")).alias("step"))
    ends = known.agg(F.count("*").alias("n"), F.min("nm").alias("min_nm"), F.max("nm").alias("max_nm"), F.count_if(fn.good_band(F.col("nm"))).alias("good"), (F.count("*") >= 15).alias("hyperspectral"))
    return ends.crossJoin(quantiles(step, {"__s": ("step", (0.5,))})).select("n", "min_nm", "max_nm", F.col("__s")[0].alias("median_step"), "good", "hyperspectral")


def edges() -> dict[str, Column]:
    """West, south, east and north of a raster (x0, y0, width, height, dx, dy)."""
    c = F.col
    return {"west": c("x0"), "south": c("y0") - c("height") * c("dy"), "east": c("x0") + c("width") * c("dx"), "north": c("y0")}


def raster_bounds(rasters: DataFrame) -> DataFrame:
    """(raster_id, west, south, east, north) in longitude and latitude: the box around the corners.  Systems that are not known are an error."""
    known = sorted(r[0] for r in rasters.select("srid").distinct().collect())  # systems: 122 at most are known
    x, y = (edges()["west"], edges()["east"]), (edges()["south"], edges()["north"])
    lon, lat = [], []
    for a in x:
        for b in y:
            p = q = None
            for srid in known:
                u, v = to_lonlat(a, b, srid)
                p = F.when(F.col("srid") == srid, u) if p is None else p.when(F.col("srid") == srid, u)
                q = F.when(F.col("srid") == srid, v) if q is None else q.when(F.col("srid") == srid, v)
            lon.append(F.lit(None).cast("double") if p is None else p)
            lat.append(F.lit(None).cast("double") if q is None else q)
    return rasters.select("raster_id", F.least(*lon).alias("west"), F.least(*lat).alias("south"), F.greatest(*lon).alias("east"), F.greatest(*lat).alias("north"))


def raster_report(rasters: DataFrame, bands: DataFrame) -> DataFrame:
    """One row a raster (raster_id, width, height, srid, dx, dy, x0, y0, tags) with its bands (raster_id, band, label, nodata, and whatever statistics).

    Sensor and date come from tags, roles from labels; the area only where the system is in metres.  A raster without a system has an `error` and
    is not left out; at most ten bands are listed.
    """
    extra = [c for c in bands.columns if c not in ("raster_id", "band", "label", "nodata")]
    r = rasters.withColumn("sensor", fn.detect_sensor(F.array_join(F.map_values("tags"), " ")))
    each = bands.join(r.select("raster_id", "sensor"), "raster_id").withColumn("role", fn.label_role(F.col("label"), F.col("sensor")))
    listed = F.slice(F.sort_array(F.collect_list(F.struct("band", "label", "role", "nodata", *extra))), 1, MOST_BANDS)
    per = each.groupBy("raster_id").agg(F.count("*").cast("int").alias("band_count"), listed.alias("bands"), F.min_by("nodata", "band").alias("nodata"))
    projected = F.col("srid") != 4326
    out = r.join(per, "raster_id", "left").withColumns(edges())
    return out.select(
        "raster_id", "width", "height", F.coalesce("band_count", F.lit(0)).alias("band_count"), "bands", (F.coalesce("band_count", F.lit(0)) > MOST_BANDS).alias("bands_truncated"), "sensor",
        F.col("tags")["ACQUISITION_DATETIME"].alias("date"), F.concat(F.lit("EPSG:"), F.col("srid").cast("string")).alias("crs"), projected.alias("crs_is_projected"), "dx", "dy",
        F.when(projected, "metre").when(F.col("srid") == 4326, "degrees").alias("resolution_units"), F.when(projected, F.bround(F.col("width") * F.col("height") * F.abs(F.col("dx") * F.col("dy")) / 1e6, 3)).alias("extent_km2"),
        "west", "south", "east", "north", "nodata", F.when(F.col("srid").isNull(), "no coordinate system").alias("error"),
    )


def vector_summary(features: DataFrame, srid: int, rings: str = "rings") -> DataFrame:
    """(geom_type, n, west, south, east, north, crs, columns) of a layer of polygons (rings) and points (x, y), a row for each kind of geometry."""
    has = set(features.columns)
    points = F.flatten(rings) if rings in has else F.array().cast("array<struct<x:double,y:double>>")
    px, py = (F.col("x"), F.col("y")) if {"x", "y"} <= has else (F.lit(None).cast("double"), F.lit(None).cast("double"))
    polygon = F.col(rings).isNotNull() if rings in has else F.lit(False)
    side = lambda pick, k, p: F.when(polygon, pick(F.transform(points, lambda v: v[k]))).otherwise(p)
    kind = F.when(polygon, "Polygon").when(px.isNotNull(), "Point").otherwise("None")
    g = features.select(kind.alias("geom_type"), side(F.array_min, "x", px).alias("x0"), side(F.array_min, "y", py).alias("y0"), side(F.array_max, "x", px).alias("x1"), side(F.array_max, "y", py).alias("y1"))
    out = g.groupBy("geom_type").agg(F.count("*").alias("n"), F.min("x0").alias("west"), F.min("y0").alias("south"), F.max("x1").alias("east"), F.max("y1").alias("north"))
    named = sorted(has - {rings, "x", "y"})
    return out.withColumns({"crs": F.lit(f"EPSG:{srid}"), "columns": F.lit(",".join(named))})


def points_summary(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, west, east, south, north, z_min, z_max) of points (x, y, z); heights to 2 decimals."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north"), F.bround(F.min("z"), 2).alias("z_min"), F.bround(F.max("z"), 2).alias("z_max"))


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, ending, kind, bytes) of every file below a folder; contents are not read."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit("other")
    for k, endings in FILE_KINDS.items():
        kind = F.when(ext.isin(*endings), k).otherwise(kind)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), ext.alias("ending"), kind.alias("kind"), F.col("length").alias("bytes"))


def dataset_report(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, n, west, south, east, north, detail, error): what each file below a folder holds, by its ending; a file that can't be read, or of
    a kind that is not read here, has an error and is reported like the others."""
    files = file_kinds(spark, path).withColumn("name", F.col("name"))
    empty = {"n": "long", "west": "double", "south": "double", "east": "double", "north": "double", "detail": "string", "error": "string"}
    here = lambda endings: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(endings) + "}")
    lines = here(("csv", "xyz", "txt")).text(path).select(F.col("_metadata.file_path").alias("path"), F.filter(F.split(F.trim("value"), r"[,\s]+"), lambda x: x != "").alias("v")).filter(F.size("v") > 0)
    number = lambda k: F.get(F.col("v"), F.lit(k)).try_cast("double")
    p = lines.select("path", number(0).alias("x"), number(1).alias("y"), number(2).alias("z"))
    bad = F.count_if(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull())
    points = p.groupBy("path").agg(F.count("z").alias("n"), F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"), F.format_string("z %.2f to %.2f", F.min("z"), F.max("z")).alias("detail"), F.when(bad > 0, F.concat(bad.cast("string"), F.lit(" lines are not x, y, z"))).alias("error"))
    whole = here(("geojson", "json")).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "type string, features array<struct<geometry:struct<type:string,coordinates:string>>>").alias("j"))
    at = F.flatten(F.transform("j.features", lambda f: F.transform(F.regexp_extract_all(f["geometry"]["coordinates"], F.lit(r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)"), F.lit(1)), lambda s: F.split(s, r"\s*,\s*"))))
    each = lambda k: F.transform(at, lambda s: F.get(s, F.lit(k)).try_cast("double"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("j.features", lambda f: f["geometry"]["type"]))), ",")
    vectors = whole.select("path", F.coalesce(F.size("j.features"), F.lit(0)).cast("long").alias("n"), *[pick(each(k)).alias(n) for n, k, pick in (("west", 0, F.array_min), ("south", 1, F.array_min), ("east", 0, F.array_max), ("north", 1, F.array_max))], kinds.alias("detail"), F.when(F.col("j.features").isNull(), "not a FeatureCollection").alias("error"))
    found = points.unionByName(vectors)
    # Paths are written with and without an authority.
    key = lambda c: F.regexp_replace(c, "^[a-zA-Z0-9]+:/*", "/")
    out = files.withColumn("__k", key(F.col("path"))).join(found.withColumn("__k", key(F.col("path"))).drop("path"), "__k", "left")
    missing = F.when(F.col("ending").isin("csv", "xyz", "txt"), "no points").otherwise(F.concat(F.lit("files of type ."), F.col("ending"), F.lit(" are not read")))
    return out.select("name", "kind", *[F.col(c).cast(t).alias(c) for c, t in empty.items() if c != "error"], F.coalesce("error", F.when(F.col("n").isNull(), missing)).alias("error"))


def companion_check(files: DataFrame, companions: DataFrame, key: str) -> DataFrame:
    """(key): files without their companion, each once."""
    return files.select(key).distinct().join(companions.select(key), key, "left_anti")


def filter_features(features: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Features whose column has one of the values; an unknown column is an error that names those there are."""
    if column not in features.columns:
        raise ValueError(f"no column {column!r}; there are {', '.join(features.columns)}")
    return features.filter(F.col(column).isin(list(values)))


def quality_gate(reports: DataFrame, mutual_share: DataFrame | None = None, least_mutual: float = 0.15) -> DataFrame:
    """One row (rasters, verdict): not_valid without a raster, insufficient_data where one has too little data or several share too little
    (mutual_share: one row, `share`), else ok."""
    g = reports.agg(F.count("*").alias("rasters"), F.coalesce(F.bool_or(F.col("verdict") != "ok"), F.lit(False)).alias("bad"))
    g = g.crossJoin(F.broadcast(mutual_share.select("share"))) if mutual_share is not None else g.withColumn("share", F.lit(1.0))
    few = (F.col("rasters") > 1) & (F.col("share") < least_mutual)
    return g.select("rasters", F.when(F.col("rasters") == 0, "not_valid").when(F.col("bad") | few, "insufficient_data").otherwise("ok").alias("verdict"))


def timeline(values: DataFrame, date: str = "d", value: str = "v", unit: str = "") -> DataFrame:
    """(index, date, value, label, low, high): one frame a date in order, its label, and the ends of the colour scale, which all frames share.

    Frames are as many as dates; two values of one date are an error.
    """
    per = values.groupBy(date).agg(F.count("*").alias("__n"), F.min(value).alias(value))
    per = per.withColumn(value, F.when(F.col("__n") > 1, F.raise_error(F.lit("two frames of one date")).cast("double")).otherwise(F.col(value)))
    ends = per.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    label = F.concat(F.col(date).cast("string"), F.lit(": "), F.floor(value).cast("string"), F.lit(f" {unit}" if unit else ""))
    order = F.row_number().over(W.orderBy(date)) - 1
    return per.crossJoin(F.broadcast(ends)).select(order.cast("int").alias("index"), F.col(date).cast("string").alias("date"), F.col(value).alias("value"), label.alias("label"), "low", "high")


def class_labels(tags: Column, text: Column) -> Column:
    """map<int,string> of class numbers and names: from tags such as class_3, then from tags that hold a JSON table, then from a description such as
    "0: dry; 1 = water"; the first name of a number counts, with a capital letter."""
    pair = lambda k, v: F.struct(k.cast("int").alias("id"), F.trim(v).alias("name"))
    number = r"(?i)^(?:class|label|category|cat|val|value|code)[_-]?(-?\d+)$"
    own = F.transform(F.filter(F.map_entries(tags), lambda e: F.trim(e["key"]).rlike(number)), lambda e: pair(F.regexp_extract(F.trim(e["key"]), number, 1), e["value"]))
    tables = [F.coalesce(F.map_entries(F.from_json(tags[k], "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>")) for k in CLASS_TAGS]
    from_tables = F.transform(F.filter(F.concat(*tables), lambda e: e["key"].rlike(r"^-?\d+$")), lambda e: pair(e["key"], e["value"]))
    listed = r"(?:^|[;,(\n:]\s*)(-?\d+)\s*(?:=|:|\s-\s|\s+)\s*([A-Za-z][^;,()\n.]*)"
    named = F.zip_with(F.regexp_extract_all(text, F.lit(listed), F.lit(1)), F.regexp_extract_all(text, F.lit(listed), F.lit(2)), pair)
    none = F.array().cast("array<struct<id:int,name:string>>")
    found = F.filter(F.concat(*[F.coalesce(x, none) for x in (own, from_tables, named)]), lambda x: x["name"] != "")

    def first(all_: Column) -> Column:
        ids = F.transform(all_, lambda x: x["id"])
        return F.filter(all_, lambda x, i: F.array_position(ids, x["id"]) == i + 1)

    kept = F.transform(F.array(found), first)[0]
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["id"], F.concat(F.upper(F.substring(x["name"], 1, 1)), F.substring(x["name"], 2, 1 << 30)))))


def class_profile(cells: DataFrame, band: str, labels: Column, most: int = 30) -> DataFrame:
    """(value, label, n, percent) of a classified band's cells, missing ones left out; more than `most` values are an error."""
    g = cells.filter(F.col(band).isNotNull()).groupBy(F.col(band).cast("int").alias("value")).agg(F.count("*").alias("n"))
    whole = W.partitionBy()
    kinds, total = F.count("*").over(whole), F.sum("n").over(whole)
    n = F.when(kinds > most, F.raise_error(F.lit(f"more than {most} values: not a classified band")).cast("long")).otherwise(F.col("n"))
    return g.limit(most + 1).select("value", F.element_at(labels, F.col("value")).alias("label"), n.alias("n"), F.bround(F.col("n") * 100.0 / total, 4).alias("percent"))


def profile_summary(profile: DataFrame) -> DataFrame:
    """One row of an elevation profile (k, distance, z): length, ends, gain, loss, steepest and mean slope in degrees, 2 decimals."""
    at = W.orderBy("k")
    p = profile.withColumns({"dz": F.col("z") - F.lag("z").over(at), "dx": F.col("distance") - F.lag("distance").over(at)})
    slope = F.degrees(F.atan(F.abs("dz") / F.greatest("dx", F.lit(0.1))))
    two = lambda c: F.bround(F.coalesce(c, F.lit(0.0)), 2)
    return p.agg(
        two(F.max("distance")).alias("distance_m"), two(F.min("z")).alias("min_m"), two(F.max("z")).alias("max_m"), two(F.sum(F.when(F.col("dz") > 0, F.col("dz")))).alias("gain_m"), two(-F.sum(F.when(F.col("dz") < 0, F.col("dz")))).alias("loss_m"),
        two(F.max(slope)).alias("max_slope"), two(F.avg(slope)).alias("avg_slope"),
    )
