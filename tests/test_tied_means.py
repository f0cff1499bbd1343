"""Days whose means are equal are ties, in whatever order their rows are added."""

import datetime

from cellscape.plans import registry


def test_equal_means_are_ties(spark, tmp_path):
    days = [[0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [0.2], [0.6, 0.0, 0.0], [0.3, 0.1, 0.2], [None]]
    rows = [(datetime.datetime(2024, 1, 1 + k, 0, i), 7, v) for k, vs in enumerate(days) for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("mann_kendall", "mann_kendall_p"):
        got = [r.asDict() for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
        assert [(r["n"], r["s"]) for r in got] == [(5, 0.0)], name
