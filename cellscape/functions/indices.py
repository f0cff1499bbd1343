"""Spectral indices as Column expressions, and the registry that names them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), missing where the sum is 0."""
    return F.try_divide(a - b, a + b)


def msavi2(b: dict[str, Column]) -> Column:
    t = 2 * b["nir"] + 1
    return 0.5 * (t - F.sqrt(F.greatest(F.lit(0.0), t * t - 8 * (b["nir"] - b["red"]))))


def savi(b: dict[str, Column]) -> Column:
    return 1.5 * (b["nir"] - b["red"]) / (b["nir"] + b["red"] + 0.5)


def evi(b: dict[str, Column]) -> Column:
    return F.try_divide(2.5 * (b["nir"] - b["red"]), b["nir"] + 6 * b["red"] - 7.5 * b["blue"] + 1)


def ibi(b: dict[str, Column]) -> Column:
    built = normalized_difference(b["swir1"], b["nir"])
    half = (savi(b) + normalized_difference(b["green"], b["swir1"])) / 2
    return F.try_divide(built - half, built + half)


def bsi(b: dict[str, Column]) -> Column:
    bare, green = b["swir1"] + b["red"], b["nir"] + b["blue"]
    return F.try_divide(bare - green, bare + green)


def _nd(x: str, y: str) -> Callable[[dict[str, Column]], Column]:
    return lambda b: normalized_difference(b[x], b[y])


@dataclass(frozen=True)
class Index:
    roles: tuple[str, ...]
    build: Callable[[dict[str, Column]], Column]


INDICES: dict[str, Index] = {
    "ndvi": Index(("nir", "red"), _nd("nir", "red")),
    "ndre": Index(("nir", "red_edge"), _nd("nir", "red_edge")),
    "ndci": Index(("red_edge", "red"), _nd("red_edge", "red")),
    "msavi2": Index(("nir", "red"), msavi2),
    "savi": Index(("nir", "red"), savi),
    "evi": Index(("nir", "red", "blue"), evi),
    "ndmi": Index(("nir", "swir1"), _nd("nir", "swir1")),
    "nbr": Index(("nir", "swir2"), _nd("nir", "swir2")),
    "ndwi": Index(("green", "nir"), _nd("green", "nir")),
    "mndwi": Index(("green", "swir1"), _nd("green", "swir1")),
    "ndbi": Index(("swir1", "nir"), _nd("swir1", "nir")),
    "ibi": Index(("swir1", "nir", "red", "green"), ibi),
    "bsi": Index(("swir1", "red", "nir", "blue"), bsi),
    "ui": Index(("swir2", "nir"), _nd("swir2", "nir")),
    "lst": Index(("thermal",), lambda b: b["thermal"]),
}


def index(name: str, bands: dict[str, Column] | None = None) -> Column:
    """The index's Column over columns named by role, or over the given ones."""
    found = INDICES.get(name.lower())
    if found is None:
        raise ValueError(f"unknown index {name!r}; there are {', '.join(sorted(INDICES))}")
    return found.build({r: (bands or {}).get(r, F.col(r)) for r in found.roles})


def register_index(name: str, roles: tuple[str, ...], build: Callable[[dict[str, Column]], Column]) -> None:
    """Add an index of one's own."""
    INDICES[name.lower()] = Index(tuple(roles), build)
