"""GeoJSON in and out as DataFrames of features: polygons as rings, points as x and y."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape.operators.grids import to_lonlat


def parse_features(df: DataFrame, column: str, properties: str) -> DataFrame:
    """(properties..., rings, x, y) from a JSON column of features: rings of Polygon and MultiPolygon (all parts' rings together), without
    their closing vertices; x and y of Point.  What a geometry has not is null."""
    schema = f"type string, properties struct<{properties.replace(' ', ':').replace(',:', ',')}>, geometry struct<type:string,coordinates:string>"
    f = df.select(F.from_json(column, schema).alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("__kind"), F.col("f.geometry.coordinates").alias("__at"))
    ring = lambda r: F.transform(F.slice(r, F.lit(1), F.greatest(F.lit(0), F.size(r) - 1)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    one = F.from_json("__at", "array<array<array<double>>>")
    many = F.flatten(F.from_json("__at", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("__kind") == "Polygon", F.transform(one, ring)).when(F.col("__kind") == "MultiPolygon", F.transform(many, ring))
    point = F.when(F.col("__kind") == "Point", F.from_json("__at", "array<double>"))
    return f.withColumns({"rings": rings, "x": F.get(point, F.lit(0)), "y": F.get(point, F.lit(1))}).drop("__kind", "__at")


def read_geojson(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """Features of FeatureCollection files, each read as one document; with `lines`, of files with one feature a line, which are split."""
    if lines:
        return parse_features(spark.read.text(path), "value", properties)
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.explode(F.from_json("value", "features array<string>")["features"]).alias("json"))
    return parse_features(items, "json", properties)


def features(df: DataFrame, rings: str = "rings", srid: int = 4326) -> Column:
    """A feature's JSON text: all columns but the geometry as properties, coordinates in WGS84 (from the system srid), rings closed.

    A column `parts` (an array of rings arrays) gives a MultiPolygon, a column of rings a Polygon, and x and y without either a Point.
    """

    def pair(x: Column, y: Column) -> Column:
        return F.array(*to_lonlat(x, y, srid))

    closed = lambda ring: F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: pair(p["x"], p["y"]))
    if "parts" in df.columns:
        used, kind, coords = {"parts"}, "MultiPolygon", F.transform("parts", lambda part: F.transform(part, closed))
    elif rings in df.columns:
        used, kind, coords = {rings}, "Polygon", F.transform(rings, closed)
    else:
        used, kind, coords = {"x", "y"}, "Point", pair(F.col("x"), F.col("y"))
    keep = [c for c in df.columns if c not in used]
    geometry = F.struct(F.lit(kind).alias("type"), coords.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*keep).alias("properties"), geometry.alias("geometry")))


def write_geojson(df: DataFrame, path: str, rings: str = "rings", srid: int = 4326) -> None:
    """One feature a line (GeoJSON text sequence without separators), in WGS84."""
    df.select(features(df, rings, srid).alias("value")).write.mode("overwrite").text(path)
