"""Operator 4, quality classifier: regularised quadratic discriminant analysis on transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and towards its own diagonal.  A document's score is the
logistic of the difference of the classes' log densities (Mahalanobis distances by triangular solves with the cached Cholesky
factors, log determinants, log priors).  Sums and cross products come from one Spark aggregation over all training rows;
the driver sees only numbers whose count depends on the statistics, not on the rows.

Cases: a null text is empty; an empty text has a score like any other; repeated labels count each; a null label, or a label
other than 0 and 1, is ignored; with labels of one class only, every score is that class; with none, every score is 0.5.  Texts
of any length are read whole; repeated rows score alike; equal scores need no order; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.llm.common import Members, fold, id_hash, in_arrow, slices, stored, table, texts_of

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARK = b"#$%&*@^_~|<>{}[]\\/+=`"
_STOP = b".!?"
_COMMA = b",;:"


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a text: logarithms of counts, square roots of shares."""
    n = len(text)
    words = text.split()
    k = len(words)
    size, count = max(n, 1), max(k, 1)
    share = lambda chars: math.sqrt((n - len(text.translate(None, chars))) / size)
    seen = Counter(words)
    lengths = list(map(len, words))
    mean = sum(lengths) / count
    spread = math.sqrt(max(0.0, sum(x * x for x in lengths) / count - mean * mean))
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = sum(map(eq, words, words[1:])) / count
    return [
        math.log1p(k),
        math.log1p(mean),
        math.log1p(spread),
        math.sqrt(len(seen) / count),
        math.sqrt(max(seen.values(), default=0) / count),
        math.sqrt(sum(v * v for v in seen.values())) / count,
        math.sqrt(again),
        math.log1p(max(lengths, default=0)),
        math.sqrt(sum(x <= 3 for x in lengths) / count),
        math.sqrt(1 - len(set(lines)) / max(len(lines), 1)),
        math.sqrt(len(lines) / count),
        share(_UPPER),
        share(_DIGIT),
        share(_MARK),
        share(_STOP),
        share(_COMMA),
        math.sqrt(text.count(b"!") / count),
        math.sqrt(len(set(zip(words, words[1:]))) / count),
    ]


N_STATISTICS = len(statistics(b""))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", among: DataFrame | None = None) -> DataFrame:
    """(id, x): the statistics of every whole text, or of those whose id is in the column id of `among`, and of a few others.

    The filter over those ids is broadcast and read in the worker that makes the statistics, so a task has one worker.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), id_hash(id_col).alias("h"))
    kind = dict(rows.dtypes)[id_col]
    shared = None if among is None else docs.sparkSession.sparkContext.broadcast(Members.of(among.select(id_hash(id_col).alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if shared is not None:
                b = b.filter(pa.array(shared.value.may_hold(b.column(2).to_numpy().view(np.uint64)), pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(x) for x in texts_of(b.column(1))], pa.list_(pa.float64()))], names=[id_col, "x"])

    return in_arrow(rows, run, f"`{id_col}` {kind}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and constants; None where only one class, or none, was seen."""

    means: np.ndarray | None
    whiten: np.ndarray | None
    constant: np.ndarray
    only: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.only)
        density = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constant)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(rows: DataFrame, to_pooled: float = 0.1, to_diagonal: float = 0.1, ridge: float = 1e-6) -> Discriminant:
    """Fit from all rows (label, x) with label 0 or 1."""
    d = N_STATISTICS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {0: np.zeros((d + 1, d + 1)), 1: np.zeros((d + 1, d + 1))}
        for b in batches:
            if b.num_rows:
                label, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, d)
                x = np.hstack([np.ones((len(x), 1)), x])
                for k in held:
                    own = x[label == k]
                    held[k] += own.T @ own
        flat = np.concatenate([held[0].ravel(), held[1].ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "v"])

    labelled = rows.filter("label in (0, 1)").select(F.col("label").cast("int").alias("label"), "x")
    got = in_arrow(labelled, sums, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 * (d + 1) ** 2)
    for at, v in got:
        flat[at] = v
    cross = flat.reshape(2, d + 1, d + 1)
    n = cross[:, 0, 0]
    if min(n) < 1:
        return Discriminant(None, None, np.zeros(2), 0.5 if max(n) < 1 else float(np.argmax(n)))
    means = cross[:, 0, 1:] / n[:, None]
    within = np.stack([cross[k, 1:, 1:] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)])
    pooled = within.sum(axis=0) / n.sum()
    whiten, constant = [], []
    for k in (0, 1):
        cov = (1 - to_pooled) * within[k] / n[k] + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + ridge * np.eye(d)
        chol = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(chol))
        constant.append(math.log(n[k] / n.sum()) - np.log(np.diag(chol)).sum())
    return Discriminant(means, np.stack(whiten), np.array(constant))


def scored(rows: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of rows (id, x)."""
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x), pa.float64())], names=[id_col, "score"])

    return in_arrow(rows.select(id_col, "x"), run, f"`{id_col}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", training: Column | None = None) -> DataFrame:
    """(id, score) for every row of docs; learns from the labelled rows for which `training` (a column over the id) holds."""
    rows = stored(with_statistics(docs, id_col, text_col))
    known = labels.select(F.col(id_col), F.col(label_col).alias("label")).filter(F.lit(True) if training is None else training)
    model = fit(rows.join(known, id_col).select("label", "x"))
    return scored(rows, model, id_col)


def kept_by_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least `least`, as they are; learns from all labelled rows.

    A broadcast filter over the labelled ids picks the texts to learn from; their statistics are joined with the labels, so
    texts are never shuffled.
    """
    known = labels.select(F.col(id_col), F.col(label_col).alias("label"))
    model = fit(with_statistics(docs, id_col, text_col, known.filter("label in (0, 1)")).join(known, id_col).select("label", "x"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            x = np.array([statistics(t) for t in texts_of(b.column(at))])
            yield b.filter(pa.array(model.scores(x) >= least))

    return in_arrow(docs, run, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 3) == 1
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), training=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
