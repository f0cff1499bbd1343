"""Streams in several micro-batches: rows out of order, late rows, idle cells."""

import math

from pyspark.sql import functions as F

from cellscape.streaming import scenes

SCHEMA = "cell long, ts timestamp, y double, mean double, std double"


def written(spark, folder, batches):
    """One file a micro-batch of (cell, minute, y)."""
    import time

    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(c, float(m), float(y)) for c, m, y in rows], "cell long, m double, y double")
        df = df.select("cell", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60).alias("ts"), "y", F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
        time.sleep(0.01)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/b*")


def walked(rows, threshold=3.0, slack=0.5):
    out, state = {}, {}
    for c, m, y in sorted(rows):
        up, down = state.get(c, (0.0, 0.0))
        up, down = max(0.0, up + y - slack), max(0.0, down - y - slack)
        hit = up > threshold or down > threshold
        out[(c, m)] = (round(up, 9), round(down, 9), hit)
        state[c] = (0.0, 0.0) if hit else (up, down)
    return out


def answers(df):
    return {(r.cell, int((r.t - 1_700_000_000) / 60)): (round(r.up, 9), round(r.down, 9), r.hit) for r in df.withColumn("t", F.unix_timestamp("ts")).collect()}


def test_rows_out_of_order_across_batches(spark, tmp_path):
    rows = [(c, m, math.sin(m * 1.7 + c) * 2) for c in (1, 2) for m in range(0, 60, 3)]
    first, second = [r for r in rows if r[1] % 2 == 0], [r for r in rows if r[1] % 2]
    end = [(1, 500, 0.0), (2, 500, 0.0)]
    got = scenes.finished(scenes.ordered_cusum(written(spark, tmp_path, [first, second, end]), late="2 hours"))
    assert answers(got) == walked(rows)


def test_late_rows_are_dropped_and_idle_cells_start_anew(spark, tmp_path):
    early = [(1, m, 1.5) for m in range(3)]
    batches = [early, [(2, 300, 0.0)], [(1, 1, 9.0), (1, 310, 1.5)], [(2, 900, 0.0)]]
    source = written(spark, tmp_path, batches)
    kept = walked([*early, (1, 310, 1.5), (2, 300, 0.0)])
    got = answers(scenes.finished(scenes.ordered_cusum(source, late="10 minutes")))
    assert got == kept  # the row of minute 1 came 299 minutes late
    anew = answers(scenes.finished(scenes.ordered_cusum(source, late="10 minutes", idle_ms=60 * 60 * 1000)))
    assert anew[(1, 310)] == (1.0, 0.0, False) != kept[(1, 310)]
    assert {k: v for k, v in anew.items() if k != (1, 310)} == {k: v for k, v in kept.items() if k != (1, 310)}


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/b0")
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/b*")
    assert scenes.finished(scenes.ordered_cusum(source)).count() == 0
