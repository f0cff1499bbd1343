"""Warps of rasters in degrees that are taller than the way between the poles."""

import math

import pytest

from cellscape.operators import grids


def test_rows_beyond_a_pole_have_no_place(spark):
    grid = grids.Grid(4326, 10.0, 50.0, 1.0, 1.0, 4, 300)  # down to 250 degrees south
    cells = spark.range(300 * 4).selectExpr("floor(id / 4) as r", "id % 4 as c", "cast(id as double) as value")
    out, target = grids.warp([(cells, grid)], ["value"], 3857, 20_000.0, "nearest")
    north, south = (math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * 6378137.0 for lat in (50.0, -89.0))
    assert target.y0 == pytest.approx(north) and target.height == math.ceil((north - south) / 20_000.0)
    got = {(x.r, x.c): x.value for x in out.collect()}
    assert len(got) == target.height * target.width
    for (r, c), value in got.items():
        lon = math.degrees((target.x0 + (c + 0.5) * 20_000.0) / 6378137.0)
        lat = math.degrees(2 * math.atan(math.exp((target.y0 - (r + 0.5) * 20_000.0) / 6378137.0)) - math.pi / 2)
        i, j = math.floor(50.0 - lat), math.floor(lon - 10.0)
        assert value == (i * 4 + j if 0 <= j < 4 else None), (r, c)


def test_grids_between_the_poles_stay_as_they_are():
    grid = grids.Grid(4326, 10.0, 50.0, 0.01, 0.01, 40, 13_999)
    assert grid.on_earth() == grid
    assert grids.Grid(3857, 0.0, 0.0, 1.0, 1.0, 5, 5).on_earth().height == 5
    # Rows north of the pole go as well; in its own system a grid stays whole.
    assert grids.Grid(4326, 0.0, 95.0, 1.0, 1.0, 2, 20).on_earth() == grids.Grid(4326, 0.0, 89.0, 1.0, 1.0, 2, 14)
    assert grids.common_grid([grids.Grid(4326, 0.0, 0.0, 1.0, 1.0, 4, 300)]).height == 300
    with pytest.raises(ValueError, match="poles"):
        grids.common_grid([grids.Grid(4326, 0.0, -95.0, 1.0, 1.0, 4, 30)], 3857)
