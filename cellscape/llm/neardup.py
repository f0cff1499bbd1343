"""Operator 2, near-duplicate groups by fast similarity sketches, banding and exact verification.

Sketch: `bands * rows` coordinates.  Round i throws every shingle into a hashed bin with a hashed value; a bin keeps the
smallest value of the first round that reaches it.  After as many rounds as coordinates, bins still empty each take the
smallest value over all shingles, so every coordinate is filled; each agrees between two sets with probability equal
to their similarity, with the concentration of minwise hashing.

Work:
1. one pass over the texts gives set size, set digest and band keys; equal sets form one class, and only classes go on;
2. in each bucket of a band, every class is checked against the bucket's smallest class on the full shingle sets;
3. links make components; where a bucket still holds several components, its classes are cut into blocks of like size and
   every pair of blocks that may hold a link across components is compared on the full sets.  Pairs of blocks are
   dealt as numbers before any set is fetched, so a hot bucket is many tasks.
With 32 bands of 5, a pair at similarity 0.8 shares no bucket with probability 3e-6.

Cases: null and empty texts, or texts without words, have an empty set and are linked with nothing; texts of fewer words than
a shingle have their whole sequence as one shingle; repeated rows share a component; rows without a doc_id take part,
and a component of none but such rows has a null component_id.  Long texts are sketched whole; their sets travel in blocks of
bounded bytes, one set at least.  Ties (equal sets, equal smallest values) have one result whatever the order of rows.  An empty
table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.llm.common import Members, WordHash, free_name, id_hash, in_arrow, may_be_in, mixed, slices, stored, table, texts_of
from cellscape.operators.graph import components

BANDS, ROWS = 32, 5
_words = WordHash()


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = _words.of(words)
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(h[:k]), np.uint64)
    for j in range(min(k, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def sketch(found: np.ndarray, t: int) -> np.ndarray:
    """t filled coordinates of a non-empty set of 64-bit hashes."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, empty, np.uint64)
    at, step = 0, max(1, 2 * t // len(found))
    while at < t and (out == empty).any():
        rounds = np.arange(at, min(t, at + step), dtype=np.uint64)
        m = mixed(found[None, :] + mixed(rounds)[:, None])
        bins = ((m >> np.uint64(52)) * np.uint64(t)) >> np.uint64(12)
        values = (rounds[:, None] << np.uint64(48)) | (m & np.uint64((1 << 48) - 1))
        fresh = np.full(t, empty, np.uint64)
        np.minimum.at(fresh, bins.ravel().astype(np.int64), values.ravel())
        out = np.where(out == empty, fresh, out)
        at += step
    for b in np.flatnonzero(out == empty):
        out[b] = (np.uint64(t + b) << np.uint64(48)) | (mixed(found, t + int(b) + 1).min() >> np.uint64(16))
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = coordinates.reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return key.view(np.int64)


def sketched(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, digest, bands) of every row; digest and bands are null for an empty set."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(given.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(x, k) for x in texts_of(b.column(1))]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            keys = [band_keys(sketch(s, bands * rows), bands, rows) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "bands"])

    return in_arrow(given, run, f"doc_id {kind}, n long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(digest, shingles) of the rows whose doc_id is in ids, and of a few others; shingles as packed sorted hashes.

    A filter of bounded size over the ids is broadcast, so texts are read where they lie and never shuffled.
    """
    given = docs.select(id_hash(id_col).alias("h"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Members.of(ids.select(id_hash("doc_id").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.filter(pa.array(shared.value.may_hold(b.column(0).to_numpy().view(np.uint64))))
            for part in slices([wanted]):
                sets = [s.tobytes() for s in (shingle_set(x, k) for x in texts_of(part.column(1))) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["digest", "shingles"])

    return in_arrow(given, run, "digest binary, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    rows = pairs.join(left, "b").join(right, "a").select("a", "b", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            ok = [similar(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return in_arrow(rows, run, "a long, b long")


def blocked(members: DataFrame, comps: DataFrame, percent: int, block: int, block_bytes: int) -> DataFrame:
    """(key, g, label, part, node, comp): the classes of every bucket that holds several components, in blocks.

    members has (key, node, n), comps (node, comp) of linked nodes.  A block has the nodes of one bucket whose sizes are of one
    group g; similar sets are of the same or of neighbouring groups.  Components with `block` nodes there have blocks of
    their own, with their number as the label; all other nodes share blocks without a label.
    """
    step = max(math.log(100 / percent), 1e-3) * 1.000001
    of = members.join(comps, "node", "left").select("key", "node", "n", "comp", F.floor(F.log("n") / step).alias("g"))
    tally = of.groupBy("key", "comp", "g").agg(F.count("*").alias("size"), F.sum("n").alias("words"))
    several = tally.groupBy("key").agg(F.count_distinct("comp").alias("comps"), F.coalesce(F.sum(F.when(F.col("comp").isNull(), F.col("size"))), F.lit(0)).alias("alone")).filter("comps + alone > 1").select("key")
    tally = stored(tally.join(several, "key").withColumn("label", F.when(F.col("size") >= block, F.col("comp"))))
    parts = tally.groupBy("key", "g", "label").agg(F.ceil(F.greatest(F.sum("size") / block, F.sum("words") * 8 / block_bytes)).alias("parts"))
    cut = tally.alias("t").join(parts.alias("p"), (F.col("t.key") == F.col("p.key")) & (F.col("t.g") == F.col("p.g")) & F.col("t.label").eqNullSafe(F.col("p.label"))).select("t.key", "t.comp", "t.g", "t.label", "p.parts")
    same = (F.col("o.key") == F.col("c.key")) & (F.col("o.g") == F.col("c.g")) & F.col("o.comp").eqNullSafe(F.col("c.comp"))
    return of.alias("o").join(cut.alias("c"), same).select("o.key", "o.g", "c.label", F.pmod(F.xxhash64("o.node"), "c.parts").alias("part"), "o.node", "o.comp")


def certified(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, block: int = 256, block_bytes: int = 1 << 20) -> DataFrame:
    """Links (a, b) between different components that share a bucket, each pair compared in the first band that it shares."""
    cells = stored(blocked(members, comps, percent, block, block_bytes))
    names = ["key", "g", "label", "part"]
    # One row a block, numbered; everything up to the last two joins is numbers only.
    blocks = stored(cells.groupBy(*names).agg(F.collect_list(F.struct("node", "comp")).alias("nodes")).withColumn("block", F.monotonically_increasing_id()))
    i = blocks.select("key", F.col("g").alias("gi"), F.col("label").alias("of_i"), F.col("block").alias("i"), F.explode(F.array("g", F.col("g") + 1)).alias("g"))
    j = blocks.select("key", "g", F.col("label").alias("of_j"), F.col("block").alias("j"))
    apart = F.col("of_i").isNull() | F.col("of_j").isNull() | (F.col("of_i") != F.col("of_j"))
    pairs = stored(i.join(j, ["key", "g"]).filter(apart & ((F.col("gi") != F.col("g")) | (F.col("i") <= F.col("j")))).select("key", "i", "j"))
    each = blocks.select("block", F.explode("nodes").alias("x")).select("block", "x.*").join(sets, "node")
    held = stored(each.groupBy("block").agg(F.collect_list(F.struct("node", F.coalesce("comp", -F.col("node") - 1).alias("comp"), "bands", "shingles")).alias("held")))
    rows = pairs.join(held.select(F.col("block").alias("i"), F.col("held").alias("left")), "i").join(held.select(F.col("block").alias("j"), F.col("held").alias("right")), "j")
    rows = rows.select("key", (F.col("i") == F.col("j")).alias("same"), "left", "right")

    def opened(held: pa.StructArray) -> tuple[list[int], np.ndarray, np.ndarray, list[np.ndarray]]:
        bands = held.field(2).flatten().to_numpy().reshape(len(held), -1)
        return held.field(0).to_pylist(), held.field(1).to_numpy(), bands, [np.frombuffer(s.as_buffer(), np.uint64) for s in held.field(3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for i in range(b.num_rows):
                key, same = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                names_a, comps_a, bands_a, sets_a = opened(b.column(2)[i].values)
                names_b, comps_b, bands_b, sets_b = opened(b.column(3)[i].values)
                band = int(np.flatnonzero(bands_a[0] == key)[0])
                for k, q in enumerate(sets_a):
                    first = (bands_b == bands_a[k]).argmax(axis=1)
                    for m in np.flatnonzero((first == band) & (comps_b != comps_a[k])):
                        if (m > k or not same) and similar(q, sets_b[m], percent):
                            left.append(names_a[k])
                            right.append(names_b[m])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return in_arrow(rows, run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, digest): one row for every row of docs."""
    base = stored(sketched(docs, id_col, text_col, k, bands, rows))
    classes = base.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    keys = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("size")).filter("size > 1")
    members = stored(keys.join(shared, "key"))
    fits = F.least("n", "head.n") * 100 >= F.greatest("n", "head.n") * percent
    pairs = stored(members.filter((F.col("node") != F.col("head.node")) & fits).select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct())
    in_buckets = stored(classes.select("digest", "rep", "node", "bands").join(members.select("node").distinct(), "node"))
    found = full_sets(docs, in_buckets.select(F.col("rep").alias("doc_id")), id_col, text_col, k)
    sets = stored(in_buckets.select("digest", "node", "bands").join(found.groupBy("digest").agg(F.first("shingles").alias("shingles")), "digest").select("node", "bands", "shingles"))
    links = stored(verified(pairs, sets, percent))
    comps = stored(components(links))
    more = certified(members.filter("size > 2").select("key", "node", "n"), comps, sets, percent)
    final = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))
    named = classes.select("digest", "rep", "node").join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = stored(named.join(least, "comp").select("digest", "component_id"))
    out = base.select("doc_id", "n", "digest").join(of, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "digest")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one document of each near-duplicate group, as it is.  Rows equal in id and text are one document.

    A filter of bounded size over the ids that go, or that occur more than once, is broadcast: rows outside it pass where they
    lie, and only the rest is joined with the decisions.
    """
    found = stored(near_duplicates(docs, id_col, text_col, k, percent).select(F.col(id_col).alias("id"), "kept"))
    unsure = found.groupBy("id").agg(F.count("*").alias("n"), F.min("kept").alias("kept")).filter("n > 1 or not kept").select(id_hash("id").alias("h"))
    may_go, kept = may_be_in(unsure)(id_hash(id_col)), free_name(docs, "kept")
    stay = found.filter("kept").select(F.col("id").alias(kept)).distinct()
    rest = docs.filter(may_go).join(stay, F.col(id_col).eqNullSafe(F.col(kept)), "left_semi").dropDuplicates([id_col, text_col])
    return docs.filter(~may_go).unionByName(rest)


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


# DuckDB: all pairs that share a shingle, and the smallest reachable doc_id.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS m FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * m >= 80 * (na + nb - m)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT x.b, r.c FROM r JOIN both_ways x ON x.a = r.a WHERE r.c < x.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
