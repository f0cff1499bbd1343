"""Boosted trees of many classes with early stopping, on MLlib's binary boosting.

One model a class, against the rest; each stops on the rows kept aside.  MLlib's own one-against-rest drops the column that says which rows
those are, and joins its models' answers in Python; here margins stay columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Transformer
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape.sources.scratch import stored


def in_threads(run: Callable, items: Sequence, most: int = 8) -> list:
    """run of each item, several at a time: the jobs of small fits fill the cluster together."""
    with ThreadPoolExecutor(max(1, min(most, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(run), items))


class BoostedModel(Transformer):
    """Adds `probability` (array, by class) and `prediction`, the class with the largest margin; of equal margins the first."""

    def __init__(self, labels: Sequence[float], models: Sequence[GBTClassificationModel]):
        super().__init__()
        self.labels, self.models = list(labels), [m.setRawPredictionCol(f"__raw{k}").setPredictionCol("").setProbabilityCol("") for k, m in enumerate(models)]

    @property
    def rounds(self) -> list[int]:
        """Trees kept, by class."""
        return [m.getNumTrees for m in self.models]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for m in self.models:
            out = m.transform(out)
        margins = [vector_to_array(f"__raw{k}")[1] for k in range(len(self.models))]
        # A margin of MLlib's boosting is half of the log odds.
        odds = [1 / (1 + F.exp(-2 * x)) for x in margins]
        total = sum(odds, F.lit(0.0))
        best = F.array_position(F.array(*margins), F.greatest(*margins) if len(margins) > 1 else margins[0])
        label = F.element_at(F.array(*[F.lit(float(x)) for x in self.labels]), best.cast("int"))
        out = out.withColumns({"probability": F.array(*[x / total for x in odds]), "prediction": label})
        return out.drop(*[f"__raw{k}" for k in range(len(self.models))])

    def save(self, path: str) -> None:
        """One folder a class, and the classes in their order."""
        for k, m in enumerate(self.models):
            m.write().overwrite().save(f"{path}/class-{k}")
        SparkSession.active().createDataFrame(list(enumerate(map(float, self.labels))), "k int, label double").coalesce(1).write.mode("overwrite").json(f"{path}/labels")

    @classmethod
    def load(cls, path: str) -> BoostedModel:
        labels = [r.label for r in SparkSession.active().read.schema("k int, label double").json(f"{path}/labels").orderBy("k").collect()]
        return cls(labels, [GBTClassificationModel.load(f"{path}/class-{k}") for k in range(len(labels))])


def boosted(rows: DataFrame, features: str, label: str, aside: str, weight: str | None = None, seed: int = 42, rounds: int = 40, depth: int = 4, step: float = 0.1, tolerance: float = 0.001) -> BoostedModel:
    """Fit on rows (features, label, aside); rows that are `aside` only tell when to stop."""
    columns = [features, label, aside, *([weight] if weight else [])]
    rows = stored(rows.select(*columns))
    labels = sorted(r[0] for r in rows.select(F.col(label).cast("double")).distinct().collect())
    more = {"weightCol": weight} if weight else {}

    def one(of: float) -> GBTClassificationModel:
        own = rows.withColumn("__own", (F.col(label) == of).cast("double"))
        trees = GBTClassifier(featuresCol=features, labelCol="__own", validationIndicatorCol=aside, validationTol=tolerance, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, **more)
        return trees.fit(own)

    return BoostedModel(labels, in_threads(one, labels))
