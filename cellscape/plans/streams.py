"""Queries on streams of the events table (section K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscape.plans.fixtures import table
from cellscape.plans.registry import query
from cellscape.streaming import scenes as ops


def arriving(spark, sf_dir):
    """The events file as a stream of (cell, ts, y)."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(F.col("user_id").alias("cell"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("y"))


# Windows that end by the final watermark, one hour behind the newest row.
_CLOSED = "SELECT cell, start, n, round_even(mean, 6) AS mean, min, max FROM (SELECT user_id AS cell, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, count(value) AS n, avg(value) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2) WHERE start + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("stream_stats", _CLOSED)
def stream_stats(spark, sf_dir):
    return ops.finished(ops.windowed_stats(arriving(spark, sf_dir), "cell", "6 hours", "1 hour")).select("cell", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.bround("mean", 6).alias("mean"), "min", "max")


# A row starts a session when the one before it is a gap or more behind; sessions that end by the final watermark.
_SESSIONS = "__o AS (SELECT user_id AS cell, ts, value, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS AS near FROM events), __n AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY cell ORDER BY ts) AS k FROM __o), __s AS (SELECT cell, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS stop, count(value) AS n, round_even(avg(value), 6) AS mean FROM __n GROUP BY cell, k)"


@query("stream_sessions", f"WITH {_SESSIONS} SELECT cell, start, stop, n, mean FROM __s WHERE stop <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_sessions(spark, sf_dir):
    return ops.finished(ops.session_stats(arriving(spark, sf_dir), "cell", "6 hours", "1 hour")).select("cell", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n", F.bround("mean", 6).alias("mean"))


_WALK = """__b AS (SELECT user_id AS cell, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY user_id),
__z AS (SELECT user_id AS cell, ts, CASE WHEN sd > 1e-6 THEN (value - m) / sd ELSE 0.0 END AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS i FROM events e JOIN __b ON cell = user_id),
__w AS (SELECT cell, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS ts, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, false AS hit FROM __b
  UNION ALL SELECT cell, i, ts, up, down, up > 3.0 OR down > 3.0 FROM (SELECT z.cell, z.i, z.ts, greatest(0.0, CASE WHEN w.hit THEN 0.0 ELSE w.up END + z.z - 0.5) AS up, greatest(0.0, CASE WHEN w.hit THEN 0.0 ELSE w.down END - z.z - 0.5) AS down FROM __w w JOIN __z z ON z.cell = w.cell AND z.i = w.i + 1))"""


@query("stream_cusum", f"WITH {_WALK} SELECT cell, ts, round_even(up, 6) AS up, round_even(down, 6) AS down, hit FROM __w WHERE i > 0", recursive=True)
def stream_cusum(spark, sf_dir):
    base = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    found = ops.finished(ops.cusum(arriving(spark, sf_dir).join(base, "cell")))
    return found.select("cell", F.col("ts").cast("timestamp_ntz").alias("ts"), F.bround("up", 6).alias("up"), F.bround("down", 6).alias("down"), "hit")


# Rows that the final watermark, one hour behind the newest row, has passed.
@query("stream_cusum_ordered", f"WITH {_WALK} SELECT cell, ts, round_even(up, 6) AS up, round_even(down, 6) AS down, hit FROM __w WHERE i > 0 AND ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)", recursive=True)
def stream_cusum_ordered(spark, sf_dir):
    base = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    found = ops.finished(ops.ordered_cusum(arriving(spark, sf_dir).join(base, "cell")))
    return found.select("cell", F.col("ts").cast("timestamp_ntz").alias("ts"), F.bround("up", 6).alias("up"), F.bround("down", 6).alias("down"), "hit")


# Windows of 6 hours that begin every 2 hours: each row is in three.
@query("stream_sliding", "SELECT cell, start, n, round_even(mean, 6) AS mean, min, max FROM (SELECT cell, start, count(value) AS n, avg(value) AS mean, min(value) AS min, max(value) AS max FROM (SELECT user_id AS cell, value, unnest([time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 2 HOURS FOR k IN range(3)]) AS start FROM events) GROUP BY 1, 2) WHERE start + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_sliding(spark, sf_dir):
    return ops.finished(ops.windowed_stats(arriving(spark, sf_dir), "cell", "6 hours", "1 hour", "2 hours")).select("cell", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.bround("mean", 6).alias("mean"), "min", "max")


@query("stream_anomaly", "SELECT cell, ts, y, round_even(base, 8) AS base, round_even(y - base, 8) AS anomaly FROM (SELECT user_id AS cell, ts, value AS y, avg(value) OVER (PARTITION BY user_id, month(ts)) AS base FROM events)")
def stream_anomaly(spark, sf_dir):
    base = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell"), F.month("ts").alias("season")).agg(F.avg("value").alias("base"))
    return ops.finished(ops.anomalies(arriving(spark, sf_dir), base)).select("cell", F.col("ts").cast("timestamp_ntz").alias("ts"), "y", F.bround("base", 8).alias("base"), F.bround("anomaly", 8).alias("anomaly"))
