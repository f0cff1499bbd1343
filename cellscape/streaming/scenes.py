"""Incremental forms of series operators: streams of rows (cell, ts, y)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellscape.sources.scratch import new_folder


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def finished(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there now, to a Parquet table in the shared folder, and read that table."""
    spark = stream.sparkSession
    out = new_folder(spark)
    # Operators with timers and lists in their state need this store; it is read when a query starts.
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed_stats(stream: DataFrame, key: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(key, start, n, mean, min, max) per time window; rows later than `late` behind the newest are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = stream.withWatermark("ts", late).groupBy(key, window).agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.min("y").alias("min"), F.max("y").alias("max"))
    return g.select(key, F.col("window.start").alias("start"), "n", "mean", "min", "max")


def session_stats(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, stop, n, mean): one row a session, closed after a gap without rows."""
    g = stream.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap)).agg(F.count("y").alias("n"), F.avg("y").alias("mean"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n", "mean")


def cusum(stream: DataFrame, threshold: float = 3.0, slack: float = 0.5, late: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """(cell, ts, up, down, hit) of rows (cell, ts, y, mean, std): two-sided CUSUM against a stored baseline, kept between batches.

    Rows of a cell are taken in order of ts and y inside a micro-batch, and batches in their order: a row that arrives behind a later
    one of an earlier batch is added to the sums as they stand then.  With `late`, rows further behind the newest are dropped; with
    `idle_ms`, a cell without rows for so long starts anew.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    if late is not None:
        stream = stream.withWatermark("ts", late)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        up, down = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "y"], kind="stable")
        ups, downs, hits = [], [], []
        for y, m, s in zip(rows["y"], rows["mean"], rows["std"]):
            z = (y - m) / s if s and s == s and s > 1e-6 else 0.0
            up, down = max(0.0, up + z - slack), max(0.0, down - z - slack)
            hit = up > threshold or down > threshold
            ups.append(up)
            downs.append(down)
            hits.append(hit)
            if hit:
                up = down = 0.0
        state.update((up, down))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"cell": rows["cell"], "ts": rows["ts"], "up": ups, "down": downs, "hit": hits})

    return stream.groupBy("cell").applyInPandasWithState(step, "cell long, ts timestamp, up double, down double, hit boolean", "up double, down double", "append", timeout)


class OrderedSums(StatefulProcessor):
    """CUSUM of one cell in order of event time: rows wait in a list until the watermark has passed them.

    An element of the list is a chunk of up to CHUNK rows, by column: state is sent and read by element.
    """

    CHUNK = 1000

    def __init__(self, threshold: float, slack: float, idle_ms: int | None):
        self.threshold, self.slack, self.idle_ms = threshold, slack, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us array<long>, y array<double>, mean array<double>, std array<double>")
        self.sums = handle.getValueState("sums", "up double, down double, last long")

    def _chunks(self, rows: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*rows[k : k + self.CHUNK]))) for k in range(0, len(rows), self.CHUNK)]

    def _wake(self, at_us: int, earlier: bool = False) -> None:
        """One timer a cell: at the earliest row that waits, or when the cell has been idle for long enough; an earlier one may stay."""
        at, timers = -(-at_us // 1000), list(self.handle.listTimers())
        if earlier and timers and min(timers) <= at:
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [(r.us, r.y, r.mean, r.std) for r in rows if r.us > passed]
        if fresh:
            # Rows that wait already are not read: their timer says when the earliest of them is due.
            self.waiting.appendList(self._chunks(fresh))
            self._wake(min(r[0] for r in fresh), earlier=True)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r for chunk in self.waiting.get() for r in zip(*chunk)), key=lambda r: (r[0], r[1] is None, r[1] or 0.0))
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        up, down, last = self.sums.get() if self.sums.exists() else (0.0, 0.0, None)
        if not rows and last is not None and self.idle_ms is not None and last + self.idle_ms * 1000 <= passed:
            self.sums.clear()
            return
        for us, y, mean, std in ready:
            if last is not None and self.idle_ms is not None and us - last > self.idle_ms * 1000:
                up = down = 0.0
            z = (y - mean) / std if y is not None and mean is not None and std and std > 1e-6 else 0.0
            up, down, last = max(0.0, up + z - self.slack), max(0.0, down - z - self.slack), us
            hit = up > self.threshold or down > self.threshold
            yield Row(cell=key[0], us=us, up=up, down=down, hit=hit)
            if hit:
                up = down = 0.0
        if ready:
            self.sums.update((up, down, last))
        if rest:
            self.waiting.put(self._chunks(rest))
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
            if self.idle_ms is not None and last is not None:
                self._wake(last + self.idle_ms * 1000)

    def close(self) -> None:
        pass


def ordered_cusum(stream: DataFrame, threshold: float = 3.0, slack: float = 0.5, late: str = "1 hour", idle_ms: int | None = None) -> DataFrame:
    """(cell, ts, up, down, hit) like `cusum`, whatever order rows arrive in.

    A row waits in its cell's state until the newest row is `late` ahead of it, then cells take their rows in order of ts and y; rows that come later than
    that are dropped.  A cell without rows for more than `idle_ms` of event time starts anew, and a timer removes its state once the watermark says so.
    State lives in RocksDB: where a query is started by hand, set STORE to ROCKSDB first.
    """
    kind = dict(stream.dtypes)["cell"]
    rows = stream.withWatermark("ts", late).select("cell", "ts", F.unix_micros("ts").alias("us"), "y", "mean", "std")
    out = rows.groupBy("cell").transformWithState(OrderedSums(threshold, slack, idle_ms), f"cell {kind}, us long, up double, down double, hit boolean", "Append", "EventTime")
    return out.select("cell", F.timestamp_micros("us").alias("ts"), "up", "down", "hit")


def anomalies(stream: DataFrame, baseline: DataFrame) -> DataFrame:
    """(cell, ts, y, base, anomaly): arriving rows against a stored baseline (cell, season, base), season being the month."""
    return stream.withColumn("season", F.month("ts")).join(baseline, ["cell", "season"], "left").select("cell", "ts", "y", "base", (F.col("y") - F.col("base")).alias("anomaly"))
