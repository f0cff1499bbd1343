"""Boosted trees: stopping on rows kept aside, several classes, saving."""

import pytest
from pyspark.sql import functions as F

from cellscape.operators import learning
from cellscape.operators.boosting import BoostedModel


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes by rings around the origin, with a tenth of the labels wrong."""
    df = spark.range(600).selectExpr("id", "cos(id) * (1 + id % 3) + sin(id * 7) / 5 as a", "sin(id) * (1 + id % 3) + cos(id * 5) / 5 as b", "cast(case when id % 10 = 0 then (id + 1) % 3 else id % 3 end as double) as label")
    return df.withColumn("r2", F.col("a") * F.col("a") + F.col("b") * F.col("b"))


def test_boosting_stops_early_and_survives_saving(spark, rows, tmp_path):
    pipeline = learning.fit(rows, ["a", "b", "r2"], "gradient_boosting", rounds=25, depth=3)
    model = pipeline.stages[-1]
    assert isinstance(model, BoostedModel) and len(model.rounds) == 3
    assert min(model.rounds) < 25  # wrong labels can't be learned: the rows aside say so
    out = pipeline.transform(rows)
    assert out.filter("prediction = label").count() > 500
    assert out.filter("abs(aggregate(probability, 0D, (s, x) -> s + x) - 1) > 1e-9").count() == 0
    model.save(f"{tmp_path}/m")
    again = BoostedModel.load(f"{tmp_path}/m")
    assert again.rounds == model.rounds and again.labels == [0.0, 1.0, 2.0]
    x = pipeline.stages[0].transform(rows)
    assert again.transform(x).select("prediction").collect() == model.transform(x).select("prediction").collect()


def test_train_report_of_boosted_trees(rows):
    got = learning.train_report(rows, ["a", "b", "r2"], folds=3, rounds=8, depth=3)
    one = got.first()
    assert one.accuracy > 0.75 and one.cv_accuracy > 0.75 and 1 <= one.rounds <= 8
