"""Tiles along the Morton curve: ranges, and the files that a window reads."""

import random

from pyspark.sql import functions as F

from cellscape.operators import cells


def code(r, c):
    return sum(((r >> k & 1) << (2 * k + 1)) | ((c >> k & 1) << (2 * k)) for k in range(31))


def test_curve_and_ranges(spark):
    df = spark.createDataFrame([(r, c) for r in (0, 1, 2, 5, 1023, 2**30) for c in (0, 3, 77, 2**30 + 5)], "r long, c long")
    assert all(x.m == code(x.r, x.c) for x in df.withColumn("m", cells.morton(F.col("r"), F.col("c"))).collect())
    rng = random.Random(1)
    for _ in range(60):
        r0, c0 = rng.randrange(40), rng.randrange(40)
        r1, c1 = r0 + rng.randrange(20), c0 + rng.randrange(20)
        ranges = cells.morton_ranges(r0, r1, c0, c1, 16)
        assert len(ranges) <= 16 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        assert all(any(a <= code(r, c) <= b for a, b in ranges) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1))
    # Enough ranges hold the window's tiles and no others.
    exact = cells.morton_ranges(3, 9, 2, 12, 10_000)
    assert sum(b - a + 1 for a, b in exact) == 7 * 11


def test_a_window_reads_few_files(spark, tmp_path):
    grid = spark.range(128 * 128).selectExpr("id div 128 as r", "id % 128 as c", "cast(id as double) as value")
    path = f"{tmp_path}/t"
    cells.write_tiles(grid, path, size=8, files=32)
    back = spark.read.parquet(path)
    assert back.drop("tile").exceptAll(grid).count() == 0 and back.count() == 128 * 128
    window = cells.window_of_tiles(back, 20, 37, 50, 70, 8)
    assert window.count() == 17 * 20
    files = {r[0] for r in back.select(F.input_file_name()).distinct().collect()}
    touched = {r[0] for r in window.select(F.input_file_name()).distinct().collect()}
    assert len(files) >= 28 and len(touched) <= 6
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "tile" in plan.split("PushedFilters", 1)[1].split("]", 1)[0]
    keyed = grid.withColumn("raster", F.lit("a")).unionByName(grid.withColumn("raster", F.lit("b")))
    cells.write_tiles(keyed, f"{tmp_path}/k", size=8, by=["raster"], files=8)
    assert cells.window_of_tiles(spark.read.parquet(f"{tmp_path}/k"), 0, 8, 0, 8, 8).groupBy("raster").count().count() == 2
    assert cells.window_of_tiles(cells.with_tiles(grid, 8), 0, 9, 0, 9, 8).count() == 81
