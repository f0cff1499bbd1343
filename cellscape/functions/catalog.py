"""Column expressions on catalog records: labels, sensors, wavelengths, dates, grids, coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band names, polarisations and sensor band codes by role.
NAME_ROLES = {
    "blue": "blue",
    "green": "green",
    "red": "red",
    "red_edge": "red_edge",
    "rededge": "red_edge",
    "b05": "red_edge",
    "nir": "nir",
    "nir08": "nir",
    "swir1": "swir1",
    "swir16": "swir1",
    "swir2": "swir2",
    "swir22": "swir2",
    "thermal": "thermal",
    "lwir11": "thermal",
    "lwir": "thermal",
    "st_b10": "thermal",
    "vv": "vv",
    "vh": "vh",
    "hh": "hh",
    "hv": "hv",
}
CODE_ROLES = {
    "sentinel2": {"B2": "blue", "B3": "green", "B4": "red", "B5": "red_edge", "B8": "nir", "B11": "swir1", "B12": "swir2"},
    "landsat": {"B2": "blue", "B3": "green", "B4": "red", "B5": "nir", "B6": "swir1", "B7": "swir2", "B10": "thermal"},
}
ROLES = ("blue", "green", "red", "red_edge", "nir", "swir1", "swir2", "thermal", "vv", "vh", "hh", "hv")
WATER_WINDOWS = ((1340.0, 1460.0), (1790.0, 1960.0))
REQUIRED_ASSETS = {
    "sentinel-2-l2a": ("B02", "B03", "B04", "B05", "B08", "B11", "B12", "SCL"),
    "landsat-c2-l2": ("blue", "green", "red", "nir08", "swir16", "swir22", "thermal", "qa_pixel"),
    "sentinel-1-rtc": ("vv", "vh"),
}


# Patterns of sensors' names in tag text, the first that fits counts; of polarisations; of band codes; of dates.
SENSOR_PATTERNS = {"sentinel1": r"sentinel-?1|\bs1[ab]\b", "sentinel2": r"sentinel-?2|\bs2[ab]\b|msil2a|msil1c", "landsat": "landsat"}
POLARISATION = r"(?:^|[^a-z])(vv|vh|hh|hv)(?:$|[^a-z])"
BAND_CODE = r"^b0*(\d+)$"
YEAR_FIRST, YEAR_LAST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"


def _chosen(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for entry in table.items() for x in entry])


def detect_sensor(text: Column) -> Column:
    """The sensor that a scene's joined tag text names, underscores read as hyphens."""
    plain = F.translate(F.lower(text), "_", "-")
    return F.coalesce(*[F.when(plain.rlike(pattern), sensor) for sensor, pattern in SENSOR_PATTERNS.items()])


def label_role(label: Column, sensor: Column) -> Column:
    """A band label's role: by name, then by polarisation, then by the sensor's band code."""
    plain = F.trim(F.lower(label))
    codes = {f"{sensor}:{code}": role for sensor, bands in CODE_ROLES.items() for code, role in bands.items()}
    found = lambda pattern: F.nullif(F.regexp_extract(plain, pattern, 1), F.lit(""))
    return F.coalesce(_chosen(NAME_ROLES)[plain], found(POLARISATION), _chosen(codes)[F.concat(sensor, F.lit(":B"), found(BAND_CODE))])


def wavelength_nm(text: Column) -> Column:
    """The first number of a text in nm: by its unit, or by the range it lies in."""
    pattern = r"([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)"
    v = F.try_to_number(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit("9999999.999999")).cast("double")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    return F.when(unit == "nm", v).when(unit == "um", v * 1000.0).when(v.between(300.0, 2600.0), v).when(v.between(0.3, 2.6), v * 1000.0)


def good_band(nm: Column, windows=WATER_WINDOWS, valid: tuple[float, float] | None = None) -> Column:
    """Finite, outside the water-vapour windows, inside the optional range."""
    ok = nm.isNotNull() & ~F.isnan(nm)
    for lo, hi in windows:
        ok = ok & ~nm.between(lo, hi)
    return ok if valid is None else ok & nm.between(*valid)


def normalized_date(text: Column, default: Column) -> Column:
    """Year first, or day first unless only the second part can be a day; an impossible date gives the default."""

    def parts(pattern: str) -> list[Column]:
        return [F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int") for k in (1, 2, 3)]

    def date(year: Column, month: Column, day: Column) -> Column:
        return F.when(year.isNotNull(), F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"))

    a, b, year = parts(YEAR_LAST)
    american = (b > 12) & (a <= 12)
    day_first = date(year, F.when(american, a).otherwise(b), F.when(american, b).otherwise(a))
    return F.coalesce(date(*parts(YEAR_FIRST)), day_first, default)


def cell_size(dx: Column, dy: Column, srid: Column, west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """Cell size in metres: degrees scaled at the middle latitude where the grid is geographic."""
    degrees = (F.abs(west) <= 180) & (F.abs(east) <= 180) & (F.abs(south) <= 90) & (F.abs(north) <= 90) & (dx < 0.1) & (dy < 0.1)
    geographic = (srid == 4326) | degrees
    lat = F.greatest(F.lit(-85.0), F.least(F.lit(85.0), (south + north) / 2))
    return F.when(geographic, F.greatest(dx * 111320.0 * F.cos(F.radians(lat)), F.lit(1.0))).otherwise(F.greatest(dx, F.lit(0.1))), F.when(geographic, F.greatest(dy * 110574.0, F.lit(1.0))).otherwise(F.greatest(dy, F.lit(0.1)))


def native_grid(west: Column, south: Column, east: Column, north: Column, coarse: Column) -> dict[str, Column]:
    """Area and native grid of a box: 30 m where `coarse`, else 10 m."""
    w = F.abs(east - west) * 111320.0 * F.greatest(F.lit(0.1), F.cos(F.radians((south + north) / 2.0)))
    h = F.abs(north - south) * 110574.0
    res = F.when(coarse, 30.0).otherwise(10.0)
    wide, high = F.greatest(F.lit(1), F.bround(w / res).cast("long")), F.greatest(F.lit(1), F.bround(h / res).cast("long"))
    return {"area_km2": F.bround(w * h / 1e6, 2), "native_m": res, "width_px": wide, "height_px": high, "within_limit": wide * high <= 36_000_000}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _before(ring: Column, i: Column) -> Column:
    """The vertex before the i-th (from 0) of a ring, its last one before its first."""
    return F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i).cast("int"))


def _cut(ring: Column, name: str, at: float, sign: float) -> Column:
    """A ring's part on one side of the line name = at, that of larger values for sign 1."""
    other = "y" if name == "x" else "x"

    def inside(p: Column) -> Column:
        return (p[name] - at) * sign >= 0

    def crossing(p: Column, q: Column) -> Column:
        along = p[other] + (at - p[name]) / (q[name] - p[name]) * (q[other] - p[other])
        return F.struct(*[(F.lit(at) if n == name else along).alias(n) for n in ("x", "y")])

    def of(ring: Column) -> Column:
        def parts(p: Column, i: Column) -> Column:
            q = _before(ring, i)
            none = F.slice(F.array(p), 1, 0)
            return F.concat(F.when(inside(p) != inside(q), F.array(crossing(q, p))).otherwise(none), F.when(inside(p), F.array(p)).otherwise(none))

        return F.flatten(F.transform(ring, parts))

    return _let(ring, of)


def clipped_ring(ring: Column, box: tuple[float, float, float, float]) -> Column:
    """A ring (array of x, y; closing vertex or not) cut by the four sides of a box (west, south, east, north), side by side.

    Where the ring leaves and enters again, the result runs along the side there and back, which has no area.
    """
    ring = F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    for name, at, sign in (("x", box[0], 1.0), ("y", box[1], 1.0), ("x", box[2], -1.0), ("y", box[3], -1.0)):
        ring = _cut(ring, name, float(at), sign)
    return ring


def ring_area(ring: Column) -> Column:
    """Area of a ring by the shoelace rule, whichever way it turns."""

    def crosses(ring: Column) -> Column:
        return F.transform(ring, lambda p, i: _before(ring, i)["x"] * p["y"] - p["x"] * _before(ring, i)["y"])

    return F.abs(F.aggregate(_let(ring, crosses), F.lit(0.0), lambda total, x: total + x)) / 2.0


def covered_area(rings: Column, box: tuple[float, float, float, float]) -> Column:
    """Area of a polygon inside a box: its first ring less the others, the holes."""
    areas = F.transform(rings, lambda ring: ring_area(clipped_ring(ring, box)))
    return _let(areas, lambda a: F.greatest(F.lit(0.0), F.coalesce(2 * F.get(a, F.lit(0)), F.lit(0.0)) - F.aggregate(a, F.lit(0.0), lambda total, x: total + x)))


def coverage_pct(box: tuple[float, float, float, float], west: Column, south: Column, east: Column, north: Column, footprint: Column | None = None) -> Column:
    """Percentage of a box (west, south, east, north) that an item covers, 1 decimal: by its footprint (rings of x, y) where it has one, else by its box."""
    w, s, e, n = (float(x) for x in box)
    across, along = F.least(F.lit(e), east) - F.greatest(F.lit(w), west), F.least(F.lit(n), north) - F.greatest(F.lit(s), south)
    by_box = F.when((across > 0) & (along > 0), across * along).otherwise(0.0)
    area = by_box if footprint is None else F.when(footprint.isNull(), by_box).otherwise(covered_area(footprint, (w, s, e, n)))
    return F.bround(F.least(F.lit(100.0), area / ((e - w) * (n - s)) * 100.0), 1)


def boa_offset(collection: Column, asset: Column, baseline: Column, date: Column) -> Column:
    """-1000 for the reflectance bands of scenes processed with baseline 4 on (unknown baseline: from 2022-01-25 on), else 0."""
    applies = (collection == "sentinel-2-l2a") & ~F.upper(asset).isin("SCL", "AOT", "WVP", "VISUAL")
    return F.when(applies & F.coalesce(baseline >= 4, date >= F.lit("2022-01-25").cast("date")), -1000).otherwise(0)
