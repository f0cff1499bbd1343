"""Rows of a fit in parts, whatever parts they come in."""

from pyspark.sql import functions as F

from cellscape.operators import learning
from cellscape.plans import learning as plans


def test_scene_model_rows_come_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    spark.range(1, 4001).select(F.col("id").alias("p_partkey"), (F.col("id") * 7 % 50 + 1).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    seen, dealt = [], learning.dealt
    monkeypatch.setattr(learning, "dealt", lambda rows, by: dealt(rows, by, 500))
    monkeypatch.setattr(learning, "fit", lambda rows, *_: seen.append(rows))
    plans._scene_model(spark, str(tmp_path), ["red", "green", "blue", "brightness"])
    whole = learning.rgb_features(plans.rgb(spark, str(tmp_path))).join(plans.view(spark, str(tmp_path), "scene_cells").select("r", "c"), ["r", "c"]).dropna()
    assert seen[0].rdd.getNumPartitions() == 8
    same = ["red", "green", "blue", "brightness"]
    assert seen[0].select(same).exceptAll(whole.select(same)).count() == whole.select(same).exceptAll(seen[0].select(same)).count() == 0


def test_parts_do_not_depend_on_how_rows_arrive(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    parts = [[list(p) for p in learning.dealt(rows.repartition(n), ["id"], 100).rdd.glom().collect()] for n in (1, 5)]
    assert parts[0] == parts[1] and len(parts[0]) == 10
