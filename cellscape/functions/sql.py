"""The engine's functions for SQL: indices as scalar functions, tile grids and date steps as table functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from cellscape.functions.indices import INDICES

#: An index's arguments and its SQL; all are temporary functions that Catalyst writes into the plan.
SCALARS = {
    **{name: (f"{a} DOUBLE, {b} DOUBLE", f"try_divide({a} - {b}, {a} + {b})") for name, (a, b) in {
        "ndvi": ("nir", "red"), "ndre": ("nir", "red_edge"), "ndci": ("red_edge", "red"), "ndmi": ("nir", "swir1"), "nbr": ("nir", "swir2"), "ndwi": ("green", "nir"),
        "mndwi": ("green", "swir1"), "ndbi": ("swir1", "nir"), "ui": ("swir2", "nir"),
    }.items()},
    "savi": ("nir DOUBLE, red DOUBLE", "1.5D * (nir - red) / (nir + red + 0.5D)"),
    "evi": ("nir DOUBLE, red DOUBLE, blue DOUBLE", "try_divide(2.5D * (nir - red), nir + 6D * red - 7.5D * blue + 1D)"),
    "msavi2": ("nir DOUBLE, red DOUBLE", "0.5D * (2D * nir + 1D - sqrt(greatest(0D, (2D * nir + 1D) * (2D * nir + 1D) - 8D * (nir - red))))"),
    "bsi": ("swir1 DOUBLE, red DOUBLE, nir DOUBLE, blue DOUBLE", "try_divide(swir1 + red - nir - blue, swir1 + red + nir + blue)"),
    "to_db": ("linear DOUBLE", "CASE WHEN linear > 0 THEN 10D * log10(linear) END"),
}
TABLES = {
    "tile_boxes": (
        "west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE, n_rows INT, n_cols INT", "tile STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE",
        "SELECT concat('T', r, '_', c), west + (east - west) * c / n_cols, north - (north - south) * (r + 1) / n_rows, west + (east - west) * (c + 1) / n_cols, north - (north - south) * r / n_rows"
        " FROM explode(sequence(0, n_rows - 1)) AS a(r), explode(sequence(0, n_cols - 1)) AS b(c)",
    ),
    "date_steps": ("first DATE, last DATE, days INT", "d DATE", "SELECT d FROM explode(sequence(first, last, make_interval(0, 0, 0, days))) AS t(d)"),
}


def index_sql(spark: SparkSession, name: str) -> tuple[str, str]:
    """The arguments and SQL of an index: as written above, or as Catalyst writes the expression of INDICES, so also of one's own."""
    if name in SCALARS:
        return SCALARS[name]
    found = INDICES[name]
    arguments = ", ".join(f"{r} DOUBLE" for r in found.roles)
    bands = spark.createDataFrame([], arguments.replace(" DOUBLE", " double"))
    built = bands.select(found.build({r: F.col(r) for r in found.roles}).alias("value"))
    return arguments, built._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names; indices that were added by register_index are among them."""
    scalars = {name: index_sql(spark, name) for name in [*SCALARS, *INDICES]}
    for name, (arguments, body) in scalars.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
    for name, (arguments, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN {body}")
    return [*scalars, *TABLES]


def register_aggregate(spark: SparkSession, name: str, function: Callable[..., float], kind: str = "double"):
    """Make function(pandas series, ...) -> value an aggregate for SQL and for `agg`; it gets a group's values as a whole, so groups must fit a worker."""
    return spark.udf.register(name, F.pandas_udf(function, kind, PandasUDFType.GROUPED_AGG))
