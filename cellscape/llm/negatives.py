"""Operator 11, hard-negative mining with bounds along a spanning tree of the anchors.

Anchors of a block and the origin have a minimum spanning tree.  A candidate's score with a child anchor differs from its score with the
parent by at most the edge's length times the candidate's norm (the origin's scores are 0, so its edges give the plain norm bound).
Bounds go down the tree; a pair is scored exactly only if its bounds overlap the window that still matters to the anchor:
- positives: from the anchor's k-th best score so far;
- negatives: from the lowest to the highest window of its positives, lower ends rising with the k-th best found in each.

Scores are integer inner products of vectors quantised as floor(scale * x), exact in doubles while they stay below 2 ** 53, else in Python
integers; beyond 64 bits they stop at the ends of the range.

Work: candidates are packed `CANDIDATES` rows to a block without a shuffle; anchors, near ones together by a sketch of signs, `ANCHORS` to a block.
Every anchor block meets every candidate block, both dealt by (anchor block, part of the candidates), so each task has bounded
blocks and a bounded number of them, whatever labels or copies are frequent.  A task returns `most` rows an anchor or positive.

Cases: rows with a null id, label or vector, or a null or non-finite component, take no part; vectors of different lengths count as followed
by zeros; repeated rows are rows of their own, each with its results (ties: smaller id, then any row of that id, as they are given); an
anchor without positives, or a positive without negatives in its window, has no rows; columns besides id, vector and label are
not read; very long vectors stand in smaller blocks; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellscape.llm.common import in_arrow, stored, table
from cellscape.operators.ranks import ranked

ANCHORS, CANDIDATES = 512, 1024
#: Candidate blocks for one task at most, and components in a block at most (one row at least).
BLOCKS_A_TASK, COMPONENTS = 8, 1 << 18
_LOW, _HIGH = -(1 << 63) + 1, (1 << 63) - 1


def quantised(vector: Column, scale: float = 256.0) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """(id, label, q) of the rows that take part."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad
    return rows.filter(whole).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("q"))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors as rows, shorter ones followed by zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat, width = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def spanning_tree(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each row (-1: the origin) and the edge's length in the minimum spanning tree of rows and origin, by Prim's rule."""
    x = a.astype(np.float64)
    near, parent = np.sqrt((x * x).sum(axis=1)), np.full(len(x), -1, np.int64)
    edge, left = np.zeros(len(x)), np.ones(len(x), bool)
    for _ in range(len(x)):
        at = int(np.argmin(np.where(left, near, np.inf)))
        left[at], edge[at] = False, near[at]
        to = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = left & (to < near)
        near[closer], parent[closer] = to[closer], at
    return parent, edge


def levels_of(parent: np.ndarray) -> list[np.ndarray]:
    """The tree's rows by depth."""
    out, at = [], np.flatnonzero(parent < 0)
    while len(at):
        out.append(at)
        at = np.flatnonzero(np.isin(parent, at))
    return out


class Scores:
    """Exact scores of one anchor block with one candidate block where bounds call for them."""

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray):
        width = max(anchors.shape[1], candidates.shape[1])
        self.a, self.c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (anchors, candidates))
        most = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (self.a, self.c)]
        self.exact = most[0] * most[1] * max(width, 1) < 1 << 53
        if self.exact:
            self.a, self.c = self.a.astype(np.float64), self.c.astype(np.float64)
        norms = np.sqrt((self.c.astype(np.float64) ** 2).sum(axis=1))
        self.norms = norms * (1 + 1e-9) + 1e-9

    def of(self, a: np.ndarray) -> np.ndarray:
        """Scores of some anchors with all candidates."""
        if self.exact:
            return (self.a[a] @ self.c.T).astype(np.int64)
        found = self.a[a].astype(object) @ self.c.T.astype(object)
        return np.clip(found, _LOW, _HIGH).astype(np.int64)

    def pairs(self, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.exact:
            return np.concatenate([np.einsum("ij,ij->i", self.a[a[k : k + 16_384]], self.c[c[k : k + 16_384]]) for k in range(0, max(len(a), 1), 16_384)]).astype(np.int64)
        found = (self.a[a].astype(object) * self.c[c].astype(object)).sum(axis=1)
        return np.clip(found, _LOW, _HIGH).astype(np.int64)

    def within(self, parent: np.ndarray, edge: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray, dense: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
        """(scores, known): exact scores of all allowed pairs that may lie in [low, high] of their anchor.

        Where many pairs of a level are called for, the level is scored as a whole.
        """
        shape = (len(self.a), len(self.c))
        scores, known = np.zeros(shape, np.int64), np.zeros(shape, bool)
        lo, hi = np.zeros((shape[0] + 1, shape[1])), np.zeros((shape[0] + 1, shape[1]))  # the last row: the origin
        for level in levels_of(parent):
            reach = (edge[level] * (1 + 1e-9))[:, None] * self.norms
            lo[level], hi[level] = lo[parent[level]] - reach, hi[parent[level]] + reach
            slack = np.maximum(np.abs(lo[level]), np.abs(hi[level])) * 1e-12
            wanted = allowed[level]
            if self.exact:  # else scores may have stopped at the ends of the range, and bound nothing
                wanted = wanted & (hi[level] + slack >= low[level][:, None]) & (lo[level] - slack <= high[level][:, None])
            if not wanted.any():
                continue
            if wanted.mean() > dense:
                scores[level] = self.of(level)
                lo[level] = hi[level] = scores[level]
                known[level] = wanted
            else:
                a, c = np.nonzero(wanted)
                a = level[a]
                scores[a, c] = found = self.pairs(a, c)
                lo[a, c] = hi[a, c] = found
                known[a, c] = True
        return scores, known


class Best:
    """The `most` best (score, then smaller id) of each group."""

    def __init__(self, groups: int, most: int):
        self.most, self.floor = most, np.full(groups, -np.inf)
        self.group = self.score = self.id = self.row = np.empty(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        g, s, i, r = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ident), (self.row, row)))
        order = np.lexsort((r, i, -s, g))
        g = g[order]
        first = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)
        place = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
        keep = place < self.most
        self.group, self.score, self.id, self.row = g[keep], s[order][keep], i[order][keep], r[order][keep]
        last = place[keep] == self.most - 1
        self.floor[self.group[last]] = self.score[last]


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of rows (row, id, label, q): their numbers as binary columns; rows stay where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:
                q = matrix(b.column(3).slice(at, most))
                take = max(1, min(len(q), COMPONENTS // max(1, q.shape[1])))
                q = q[:take]
                held = [b.column(k).slice(at, take).to_numpy().tobytes() for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*held, q.tobytes())], names=["row", "id", "label", "q"])
                at += take

    return in_arrow(rows.select("row", "id", "label", "q"), run, "row binary, id binary, label binary, q binary")


def anchor_blocks(anchors: DataFrame, size: int = ANCHORS) -> DataFrame:
    """(i, row, id, label, q, parent, edge): blocks of anchors, near ones together, each with its tree."""
    # The sketch's order only makes trees short; blocks hold all anchors whatever it is.
    def side(plane: int) -> Column:
        signed = F.transform("q", lambda x, k: F.when(F.pmod(F.xxhash64(k + plane * 100_003), F.lit(2)) == 0, x).otherwise(-x).cast("double"))
        return (F.aggregate(signed, F.lit(0.0), lambda total, x: total + x) >= 0).cast("int")

    key = F.lit(0)
    for plane in range(12):
        key = key * 2 + side(plane)
    part = F.struct(key.alias("sketch"), F.shiftright("row", 33).alias("from"))
    order = ranked(anchors, [], part, [F.col("row")], "rank").withColumn("i", F.floor(F.col("rank") / size))
    grouped = order.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("row", "id", "label", "q"))).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                held = b.column(1)[k].values
                q = matrix(held.field(3))
                parent, edge = spanning_tree(q)
                parts = [*(held.field(j).to_numpy().tobytes() for j in range(3)), q.tobytes(), parent.tobytes(), edge.tobytes()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), *(pa.array([x], pa.binary()) for x in parts)], names=["i", "row", "id", "label", "q", "parent", "edge"])

    return in_arrow(grouped, run, "i long, row binary, id binary, label binary, q binary, parent binary, edge binary")


def met(anchors: DataFrame, blocks: DataFrame, n_anchor_blocks: int, n_blocks: int) -> DataFrame:
    """Every anchor block beside every candidate block, dealt by (i, part)."""
    parts = max(1, -(-n_blocks // BLOCKS_A_TASK))
    left = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = blocks.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_anchor_blocks - 1).cast("long"))))
    right = right.select("i", "part", *[F.col(c).alias(f"c_{c}") for c in ("row", "id", "label", "q")])
    return left.join(right, ["i", "part"]).drop("part")


def _numbers(b: pa.RecordBatch, name: str, k: int, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(b.column(b.schema.get_field_index(name))[k].as_buffer(), kind)


def _block(b: pa.RecordBatch, k: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, ident, label = (_numbers(b, prefix + c, k) for c in ("row", "id", "label"))
    return row, ident, label, _numbers(b, prefix + "q", k).reshape(len(row), -1)


def best_positives(pairs: DataFrame, most: int) -> DataFrame:
    """(i, a, k, anchor_id, positive_id, positive_score): the best rows of the same label of anchor number a of block i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, ids = None, None, None

        def told() -> pa.RecordBatch:
            cols = [pa.array([at] * len(best.group), pa.int64()), *map(pa.array, (best.group, ids[best.group], best.id, best.row, best.score))]
            return pa.RecordBatch.from_arrays(cols, names=["i", "a", "anchor_id", "positive_id", "positive_row", "positive_score"])

        for b in batches:
            for k in range(b.num_rows):
                row, ident, label, q = _block(b, k)
                if (i := b.column(0)[k].as_py()) != at:
                    if best is not None:
                        yield told()
                    at, best, ids = i, Best(len(row), most), ident
                c_row, c_id, c_label, c_q = _block(b, k, "c_")
                allowed = (label[:, None] == c_label) & (row[:, None] != c_row)
                scores, known = Scores(q, c_q).within(_numbers(b, "parent", k), _numbers(b, "edge", k, np.float64), best.floor, np.full(len(row), np.inf), allowed)
                a, c = np.nonzero(known & (scores >= best.floor[:, None]))
                best.add(a, scores[a, c], c_id[c], c_row[c])
        if best is not None:
            yield told()

    found = in_arrow(pairs, run, "i long, a long, anchor_id long, positive_id long, positive_row long, positive_score long")
    first = W.partitionBy("i", "a").orderBy(F.col("positive_score").desc(), "positive_id", "positive_row")
    return found.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= most).drop("positive_row")


def best_negatives(pairs: DataFrame, most: int, percent: int) -> DataFrame:
    """The best rows of other labels in the window of each positive; pairs has the positives of each anchor block in `positives`."""

    def windows(held: pa.StructArray, n: int) -> tuple[np.ndarray, ...]:
        """Of each positive: its anchor's number, id, score and the window's lower end; positives below 0 have no window."""
        a, ident, score, k = (held.field(j).to_numpy() for j in range(4))
        open_ = score >= 0
        low = np.array([-(-percent * int(s) // 100) for s in score[open_]], np.int64)
        return a[open_], ident[open_], score[open_], low, k[open_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, ids, of = None, None, None, None

        def told() -> pa.RecordBatch:
            g = best.group
            cols = [pa.array([at] * len(g), pa.int64()), *map(pa.array, (of[0][g], of[4][g].astype(np.int64), ids[of[0][g]], of[1][g], of[2][g], best.id, best.row, best.score))]
            return pa.RecordBatch.from_arrays(cols, names=["i", "a", "k", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_row", "negative_score"])

        for b in batches:
            for k in range(b.num_rows):
                row, ident, label, q = _block(b, k)
                if (i := b.column(0)[k].as_py()) != at:
                    if best is not None:
                        yield told()
                    at, ids, of = i, ident, windows(b.column(b.schema.get_field_index("positives"))[k].values, len(row))
                    best = Best(len(of[0]), most)
                c_row, c_id, c_label, c_q = _block(b, k, "c_")
                floor = np.maximum(of[3], best.floor)
                low, high = np.full(len(row), np.inf), np.full(len(row), -np.inf)
                np.minimum.at(low, of[0], floor)
                np.maximum.at(high, of[0], of[2])
                allowed = label[:, None] != c_label
                scores, known = Scores(q, c_q).within(_numbers(b, "parent", k), _numbers(b, "edge", k, np.float64), low, high, allowed)
                for place in np.unique(of[4]):
                    g = np.flatnonzero(of[4] == place)
                    s = scores[of[0][g]]
                    x, c = np.nonzero(known[of[0][g]] & (s <= of[2][g][:, None]) & (s >= of[3][g][:, None]) & (s >= best.floor[g][:, None]))
                    best.add(g[x], s[x, c], c_id[c], c_row[c])
        if best is not None:
            yield told()

    found = in_arrow(pairs, run, "i long, a long, k long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_row long, negative_score long")
    first = W.partitionBy("i", "a", "k").orderBy(F.col("negative_score").desc(), "negative_id", "negative_row")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)


def mined(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, q); anchors are those for which `anchor` (over id) holds.

    An anchor's positives are its best rows of the same label; a positive's negatives the best rows of other labels that score at least
    `percent` hundredths of its score and not above it.
    """
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    blocks, anchors = stored(packed(rows, CANDIDATES)), stored(anchor_blocks(rows.filter(anchor)))
    n = anchors.count(), blocks.count()
    near = stored(best_positives(met(anchors, blocks, *n), positives))
    held = near.groupBy("i").agg(F.collect_list(F.struct("a", "positive_id", "positive_score", "k")).alias("positives"))
    return best_negatives(met(anchors.join(held, "i"), blocks, *n), negatives, percent).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(rows, F.col("id") % 100 == 0)


# DuckDB: all pairs of an anchor and a row.
SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS anchor, a.id AS anchor_id, a.label = b.label AS same, b.r, b.id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.id % 100 = 0
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, r) <= 5),
n AS (
  SELECT p.anchor, p.r, p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.id, s.r) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
