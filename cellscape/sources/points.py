"""Point clouds from delimited text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, path: str, most: int | None = None, bbox: tuple[float, float, float, float] | None = None, classes: Sequence[int] | None = None, class_column: int = 3) -> DataFrame:
    """(x, y, z, cls) of comma-separated (.csv) or white-space text; rows whose first three fields are no numbers (a header) are left out.

    cls is the field number `class_column`, 0 where there is none or it is no whole number.  bbox is (xmin, ymin, xmax, ymax),
    inclusive; `classes` keeps the points of those classes.  `most` points at most, all of them by default.
    """
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s*,\s*|\s+").alias("p")).filter(F.size("p") >= 3)
    cls = F.coalesce(F.get("p", F.lit(class_column)).try_cast("tinyint"), F.lit(0).cast("tinyint"))
    points = lines.select(*[F.col("p")[i].try_cast("double").alias(n) for i, n in enumerate("xyz")], cls.alias("cls")).dropna()
    if bbox is not None:
        points = points.filter(F.col("x").between(bbox[0], bbox[2]) & F.col("y").between(bbox[1], bbox[3]))
    if classes is not None:
        points = points.filter(F.col("cls").isin(*classes))
    return points if most is None else points.limit(most)
