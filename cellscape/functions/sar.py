"""Radar backscatter expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_db(linear: Column) -> Column:
    """10 log10(x); missing for x <= 0."""
    return F.when(linear > 0, 10 * F.log10(linear))
