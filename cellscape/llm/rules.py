"""Operator 12, quality rules by weak supervision.

Each rule looks at a text's statistics and votes good, bad or abstains.  Nobody says which rule is right: expectation-maximisation
over all documents estimates, for good and for bad documents, how often each rule votes which way, and the share of good documents.
A document is kept when its posterior probability of being good is high enough, so one failed rule rejects nothing by
itself and one passed rule saves nothing.

Work: one pass over the texts gives statistics and votes; documents are then counted by their votes (3 ** rules kinds at most: 59,049
for ten rules, whatever the number of rows), and EM runs over those counts, which hold all documents.

Cases: a null text has no words; a text without words has votes like any other; with no rows the prior stands; repeated rows
count each and have equal results, as have texts with equal votes (ties); texts of any length are read whole; columns besides id
and text are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.llm.common import in_arrow, slices, stored, table, texts_of

GOOD, BAD, ABSTAIN = 1, 0, 2
#: Rules at most: bounds what reaches the driver.
MOST_RULES = 10
SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER, _STOPS = bytes(range(65, 91)), bytes(range(97, 123)), b".!?"
_SPACE = b" \t\n\r\x0b\x0c"
#: The rest of a word from its first symbol on; symbols alone as a word or three times in a row.
_MARKED = re.compile(rb"[#*$%&|<>][^\x20\x09-\x0D]*")
_DECORATION = re.compile(rb"(?<![^\x20\x09-\x0D])[#*$%&|<>]+(?![^\x20\x09-\x0D])|([#*$%&|<>])\1\1+")
_CONTINUED = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of three words that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    w = np.fromiter((known.setdefault(x, len(known)) for x in words), np.int64, n)
    pair = np.unique(w[:-1] * len(known) + w[1:], return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * len(known) + w[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[which] > 1)
    hit = np.zeros(n, bool)
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


@dataclass(frozen=True)
class Stats:
    """Counts of a text that the rules look at."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_distinct: int
    upper: int
    lower: int
    stops: int
    shouts: int
    marked: int
    decorations: int


def statistics(text: bytes) -> Stats:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    without = lambda chars: len(text) - len(text.translate(None, chars))
    return Stats(
        n_words=len(words),
        word_chars=len(text.translate(None, _SPACE + _CONTINUED)),
        n_symbols=without(SYMBOLS),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated_words(words),
        n_lines=len(lines),
        n_distinct=len(set(words)),
        upper=without(_UPPER),
        lower=without(_LOWER),
        stops=without(_STOPS),
        shouts=text.count(b"!!") + text.count(b"??"),
        marked=len(_MARKED.findall(text)),
        decorations=sum(1 for _ in _DECORATION.finditer(text)),
    )


@dataclass(frozen=True)
class Rule:
    name: str
    vote: Callable[[Stats], int]


def between(value: Callable[[Stats], float], good: tuple[float, float], bad_below: float = -math.inf, bad_above: float = math.inf) -> Callable[[Stats], int]:
    """A vote by a number: good inside a range, bad beyond outer limits, else none."""

    def vote(s: Stats) -> int:
        x = value(s)
        return GOOD if good[0] <= x <= good[1] else BAD if x < bad_below or x > bad_above else ABSTAIN

    return vote


def _share(part: str, whole: str) -> Callable[[Stats], float]:
    return lambda s: getattr(s, part) / max(getattr(s, whole), 1)


#: Three views or so of each way in which a text may be bad: a rule that stands alone teaches EM nothing.
RULES = (
    Rule("length", between(lambda s: s.n_words, (80, 20_000), bad_below=50)),
    Rule("symbols", between(_share("n_symbols", "n_words"), (0, 0.05), bad_above=0.2)),
    Rule("marked_words", between(_share("marked", "n_words"), (0, 0.05), bad_above=0.15)),
    Rule("decorations", between(_share("decorations", "n_words"), (0, 0.02), bad_above=0.1)),
    Rule("repeated_lines", between(_share("n_dup_lines", "n_lines"), (0, 0.1), bad_above=0.3)),
    Rule("repeated_words", between(_share("n_repeat_words", "n_words"), (0, 0.15), bad_above=0.4)),
    Rule("variety", between(lambda s: s.n_distinct / max(1.0, math.sqrt(s.n_words)), (2.5, math.inf), bad_below=1.5)),
    Rule("capitals", between(lambda s: s.upper / max(s.upper + s.lower, 1), (0, 0.15), bad_above=0.4)),
    Rule("sentences", between(_share("n_words", "stops"), (4, 40), bad_below=2, bad_above=100)),
    Rule("shouting", between(_share("shouts", "n_words"), (0, 0.01), bad_above=0.05)),
)


def voted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the counts of Stats, votes): one pass over the whole texts."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{MOST_RULES} rules at most")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    names, kind = list(Stats.__dataclass_fields__), dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [statistics(x) for x in texts_of(b.column(1))]
            counts = [pa.array([getattr(s, n) for s in found], pa.int64()) for n in names]
            votes = pa.array([[r.vote(s) for r in rules] for s in found], pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, votes], names=[id_col, *names, "votes"])

    return in_arrow(rows, run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names) + ", votes array<tinyint>")


@dataclass(frozen=True)
class Model:
    """share: prior of good; chance[y, rule, vote] for bad (0) and good (1) documents."""

    share: float
    chance: np.ndarray
    rounds: int

    def log_odds(self) -> tuple[float, np.ndarray]:
        return math.log(self.share / (1 - self.share)), np.log(self.chance[1]) - np.log(self.chance[0])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        base, w = self.log_odds()
        return 1 / (1 + np.exp(-np.clip(base + w[np.arange(w.shape[0]), votes].sum(axis=1), -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Of each rule, the share of its votes that are right."""
        right = self.share * self.chance[1, :, GOOD] + (1 - self.share) * self.chance[0, :, BAD]
        wrong = self.share * self.chance[1, :, BAD] + (1 - self.share) * self.chance[0, :, GOOD]
        return right / (right + wrong)


#: What is believed before any document is seen, by class (bad, good) and vote (bad, good, none): a rule sees one way of being bad, so it
#: passes many bad documents, but a good document seldom fails it.
BELIEF = ((0.40, 0.45, 0.15), (0.05, 0.80, 0.15))


def fit(votes: np.ndarray, counts: np.ndarray, strength: float = 10.0, most_rounds: int = 200, settled: float = 1e-9) -> Model:
    """EM over distinct vote vectors and how many documents have each.

    Starts from BELIEF; `strength` pseudo-documents a class, voting so, keep a rule that hardly votes from having chances of 0.
    """
    n_rules = votes.shape[1]
    pseudo = np.repeat(np.array(BELIEF)[:, None, :], n_rules, axis=1)
    one = np.eye(3)[votes]
    model, total = Model(0.5, pseudo, 0), counts.sum()
    for k in range(1, most_rounds + 1):
        good = model.posterior(votes)
        weights = np.stack([counts * (1 - good), counts * good])
        chance = strength * pseudo + np.einsum("yp,prv->yrv", weights, one)
        share = (weights[1].sum() + strength) / (total + 2 * strength)
        new = Model(float(share), chance / chance.sum(axis=2, keepdims=True), k)
        done = max(abs(new.share - model.share), float(np.abs(new.chance - model.chance).max())) < settled
        model = new
        if done:
            break
    return model


def fitted(rows: DataFrame) -> Model:
    """The model of all rows (votes)."""
    got = rows.groupBy("votes").agg(F.count("*").alias("n")).collect()
    n_rules = len(got[0][0]) if got else len(RULES)
    # In one order, so that sums do not depend on how rows were dealt.
    got = sorted((list(v), n) for v, n in got)
    return fit(np.array([v for v, _ in got], np.int64).reshape(-1, n_rules), np.array([n for _, n in got], np.float64))


def posterior(votes: Column, model: Model) -> Column:
    """The probability of being good as a column."""
    base, w = model.log_odds()
    odds = F.lit(float(base))
    for j, weights in enumerate(w):
        odds = odds + F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (votes[j] + 1).cast("int"))
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.25, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """(id, counts, votes, quality, good) of every row, and the model; good: quality, the posterior, is at least `least` (a document goes when it is three times likelier bad than good)."""
    rows = stored(voted(docs, rules, id_col, text_col))
    model = fitted(rows)
    return rows.withColumn("quality", posterior(F.col("votes"), model)).withColumn("good", F.col("quality") >= least), model


def accuracy_table(spark, model: Model, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, accuracy, votes_good, votes_bad): what EM found about each rule; the last two by class shares."""
    mixed = model.share * model.chance[1] + (1 - model.share) * model.chance[0]
    return spark.createDataFrame([(r.name, float(a), float(m[GOOD]), float(m[BAD])) for r, a, m in zip(rules, model.accuracies(), mixed)], "rule string, accuracy double, votes_good double, votes_bad double")


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows, _ = judged(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "quality")
