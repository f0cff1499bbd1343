"""Operator 13, Merkle dataset manifest: a tree of SHA-256 digests over rows, with kept midstates.

A leaf is the digest of a row's fields; per source, leaves stand in order of their ids, and every `RUN` consecutive nodes (the last run:
fewer) become the digest of their digests until one is left, the source's subroot.  Subroots, in order of their sources, become
the root in the same way.

A parent keeps a copy of its hash state before each child slot.  Folding a leaf resumes the state of its slot with the
replacement and the siblings to its right only; those to its left are in the state.

Work: rows are sorted once by (source, id) and numbered by two-level counts.  `LEVELS` levels of a tree at a time are one block (2,187 nodes
at most), so a hot source is many tasks; blocks' roots are the nodes of the next stage, a 2,187th of the rows.  On the way down each
block gets the path above it, which all its leaves share: the states along that path are made once a block.

Cases: a null field counts as `-`, an empty text as `0:`; a null source is a source of its own, first; rows without an id come first in
their source; rows of equal id (ties) stand in the order of their digests, and rows equal in all fields are leaves of their own; texts
of any length are hashed whole; a source of one row has its leaf as subroot, a table of one source has the subroot as root; columns
besides the named ones are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellscape.llm.common import in_arrow, stored, table

RUN, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """Each field as its length in bytes, a colon and its value, or `-` where it is null; then SHA-256."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def height(nodes: int) -> int:
    """Rounds until one node is left."""
    h = 0
    while nodes > 1:
        nodes, h = -(-nodes // RUN), h + 1
    return h


class Subtree:
    """The nodes of one block, level by level, and each parent's hash states before its child slots."""

    def __init__(self, leaves: list[str], levels: int):
        self.levels, self.states = [[x.encode() for x in leaves]], []
        for _ in range(levels):
            below, parents, kept = self.levels[-1], [], []
            for at in range(0, len(below), RUN):
                h, before = hashlib.sha256(), []
                for child in below[at : at + RUN]:
                    before.append(h.copy())
                    h.update(child)
                kept.append(before)
                parents.append(h.hexdigest().encode())
            self.levels.append(parents)
            self.states.append(kept)

    @property
    def root(self) -> str:
        return self.levels[-1][0].decode()

    def siblings(self, leaf: int) -> Iterator[tuple[bytes, bytes]]:
        """Level by level, what stands left and right of the leaf's ancestor in its run."""
        for nodes in self.levels[:-1]:
            at = leaf // RUN * RUN
            yield b"".join(nodes[at:leaf]), b"".join(nodes[leaf + 1 : at + RUN])
            leaf //= RUN

    def fold(self, leaf: int, value: bytes) -> bytes:
        """The block's root with `value` in place of a leaf: the kept state of each slot, the value, the right siblings."""
        for nodes, states in zip(self.levels, self.states):
            parent, slot = divmod(leaf, RUN)
            h = states[parent][slot].copy()
            h.update(value)
            for right in nodes[leaf + 1 : parent * RUN + RUN]:
                h.update(right)
            value, leaf = h.hexdigest().encode(), parent
        return value


class Path:
    """Above a block: hash states after the left siblings of each level, and the right siblings."""

    def __init__(self, left: list[str], right: list[str]):
        self.proof = "".join(a + b for a, b in zip(left, right)).encode()
        self.steps = [(hashlib.sha256(a.encode()), b.encode()) for a, b in zip(left, right)]

    def fold(self, value: bytes) -> bytes:
        for state, right in self.steps:
            h = state.copy()
            h.update(value + right)
            value = h.hexdigest().encode()
        return value


def placed(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rows with `pos`, from 0 among those of a key in the given order, and `total`, their number.

    A sort by ranges over all keys: a key's rows are as many partitions as they need.  Rows in a partition are counted by its
    number; a window adds up one row for each key and partition.
    """
    by = [F.col(key).asc_nulls_first(), *order]
    at = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    parts = at.groupBy(key, "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = W.partitionBy(key)
    parts = parts.select(F.col(key).alias("of"), F.col("part").alias("p"), "first", F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    out = at.join(parts, at[key].eqNullSafe(parts["of"]) & (F.col("part") == F.col("p")))
    return out.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("of", "p", "part", "at", "first", "before")


def in_blocks(nodes: DataFrame, key: str, more: list[str]) -> DataFrame:
    """(key, block, total, items): the nodes (pos, digest, *more) of each block, by position."""
    items = F.sort_array(F.collect_list(F.struct("pos", "digest", *more)))
    return stored(nodes.groupBy(key, F.floor(F.col("pos") / RUN**LEVELS).alias("block"), "total").agg(items.alias("items")))


def roots_of(blocks: DataFrame, key: str) -> DataFrame:
    """(key, pos, total, digest): one node a block, for the next stage."""
    rows = blocks.select(key, "block", "total", F.col("items.digest").alias("leaves"))
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            totals = b.column(2).to_pylist()
            found = [Subtree(b.column(3)[i].as_py(), min(LEVELS, height(n))).root for i, n in enumerate(totals)]
            above = [-(-n // RUN ** min(LEVELS, height(n))) for n in totals]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(above, pa.int64()), pa.array(found, pa.string())], names=[key, "pos", "total", "digest"])

    return in_arrow(rows, run, f"`{key}` {kind}, pos long, total long, digest string")


def paths(nodes: DataFrame, key: str) -> DataFrame:
    """(key, pos, left, right, top): for each node (key, pos, total, digest) its siblings, level by level up to its key's top node."""
    none = F.array().cast("array<string>")
    if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
        return nodes.select(key, "pos", none.alias("left"), none.alias("right"), F.col("digest").alias("top"))
    blocks = in_blocks(nodes, key, [])
    rows = with_paths(blocks, paths(roots_of(blocks, key), key), key).select(key, "total", F.col("items.digest").alias("leaves"), F.col("items.pos").alias("at"), "left", "right", "top")
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                total, leaves, at, left, right, top = (b.column(k)[i].as_py() for k in range(1, 7))
                tree, n = Subtree(leaves, min(LEVELS, height(total))), len(leaves)
                both = [list(tree.siblings(j)) for j in range(n)]
                own = [pa.array([[x[side].decode() for x in s] + rest for s in both], pa.list_(pa.string())) for side, rest in ((0, left), (1, right))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * n)), pa.array(at, pa.int64()), *own, pa.array([top] * n, pa.string())], names=[key, "pos", "left", "right", "top"])

    return in_arrow(rows, run, f"`{key}` {kind}, pos long, left array<string>, right array<string>, top string")


def with_paths(blocks: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """blocks with the path (left, right, top) of their roots."""
    of = above.select(F.col(key).alias("of"), F.col("pos").alias("p"), "left", "right", "top")
    return blocks.join(of, blocks[key].eqNullSafe(of["of"]) & (F.col("block") == F.col("p"))).drop("of", "p")


def manifest(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", with_proof: bool = False) -> DataFrame:
    """(id, source, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (id, source, leaf, changed).

    `changed` is the leaf to fold in place of a row's own, or null where that is the same.  With `with_proof` the column
    `proof` has the siblings' digests as text, level by level, left to right.
    """
    given = rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col("leaf").alias("digest"), "changed")
    kinds = dict(given.dtypes)
    blocks = in_blocks(placed(stored(given), "source", [F.col("id").asc_nulls_first(), F.col("digest"), F.col("changed")]), "source", ["id", "changed"])
    upper = stored(paths(roots_of(blocks, "source"), "source"))
    subroots = upper.filter("pos = 0").select(F.lit(0).alias("all"), "source", F.col("top").alias("digest"))
    sources = stored(placed(stored(subroots), "all", [F.col("source").asc_nulls_first()]))
    tops = sources.select("all", "pos", "source").join(paths(sources.select("all", "pos", "total", "digest"), "all").drop("all"), "pos")
    tops = tops.select(F.col("source").alias("of"), F.col("left").alias("left_of"), F.col("right").alias("right_of"), F.col("top").alias("root"))
    above = stored(upper.join(tops, upper["source"].eqNullSafe(tops["of"])).select("source", "pos", F.concat("left", "left_of").alias("left"), F.concat("right", "right_of").alias("right"), F.struct("top", "root").alias("top")))
    found = with_paths(blocks, above, "source").select("source", "total", "items", "left", "right", "top.top", "top.root")
    names = [id_col, source_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if with_proof else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                total, left, right, subroot, root = (b.column(k)[i].as_py() for k in (1, 3, 4, 5, 6))
                items = b.column(2)[i].values
                leaves, changed, n = items.field(1).to_pylist(), items.field(3).to_pylist(), len(items)
                tree, path = Subtree(leaves, min(LEVELS, height(total))), Path(left, right)
                folded = [path.fold(tree.fold(j, (changed[j] or leaves[j]).encode())).decode() for j in range(n)]
                proofs = [b"".join(x + y for x, y in tree.siblings(j)) + path.proof for j in range(n)]
                out = [items.field(2), b.column(0).take(pa.array([i] * n)), items.field(1), *(pa.array([x] * n, pa.string()) for x in (subroot, root)), pa.array([hashlib.sha256(p).hexdigest() for p in proofs], pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())]
                yield pa.RecordBatch.from_arrays(out + ([pa.array([p.decode() for p in proofs], pa.string())] if with_proof else []), names=names)

    schema = f"`{id_col}` {kinds['id']}, `{source_col}` {kinds['source']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return in_arrow(found, run, schema + (", proof string" if with_proof else ""))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, changes: dict[str, Column] | None = None, where: Column | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, source, leaf, changed): digests of the rows, and of the rows with `changes` (field: value) where `where` holds and a change makes a difference."""
    own = leaf_digest([F.col(f) for f in fields])
    changed = F.lit(None).cast("string")
    if changes:
        differs = F.lit(False)
        for f, value in changes.items():
            differs = differs | ~F.col(f).eqNullSafe(value)
        changed = F.when((F.lit(True) if where is None else where) & differs, leaf_digest([changes.get(f, F.col(f)) for f in fields]))
    return docs.select(F.col(id_col), F.col(source_col), own.alias("leaf"), changed.alias("changed"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = leaves(table(spark, sf_dir, "documents"), changes={"text": F.translate("text", "\n", "")}, where=tampered)
    return manifest(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# DuckDB: level by level by recursion; crc32 through its table of 256 remainders.
SQL = r"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS v FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])) & 1 AS low
  FROM documents, crc
), f AS (
  SELECT doc_id, source, text, low = 1 AS tampered,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    replace(text, chr(10), '') AS cut
  FROM d
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || CASE WHEN tampered THEN coalesce(strlen(cut) || ':' || cut, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS folded
  FROM f
), numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
up AS (
  SELECT 0 AS level, source, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM numbered
  UNION ALL
  SELECT level + 1, source, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY level, source, pos // 3, n
), subroots AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM up WHERE n = 1),
over AS (
  SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM over WHERE n > 1 GROUP BY level, pos // 3, n
), runs AS (SELECT level, source, pos // 3 AS parent, list(digest ORDER BY pos) AS run FROM up WHERE n > 1 GROUP BY ALL),
over_runs AS (SELECT level, pos // 3 AS parent, list(digest ORDER BY pos) AS run FROM over WHERE n > 1 GROUP BY ALL),
a AS (
  SELECT doc_id, leaf, source, pos AS first, 0 AS level, pos, folded AS v, '' AS proof FROM numbered
  UNION ALL
  SELECT doc_id, leaf, a.source, first, a.level + 1, pos // 3,
    sha256(array_to_string(run[1 : pos % 3], '') || v || array_to_string(run[pos % 3 + 2 :], '')),
    proof || array_to_string(run[1 : pos % 3], '') || array_to_string(run[pos % 3 + 2 :], '')
  FROM a JOIN runs r ON r.level = a.level AND r.source IS NOT DISTINCT FROM a.source AND r.parent = a.pos // 3
), done AS (SELECT doc_id, leaf, source, first, v, proof FROM a QUALIFY row_number() OVER (PARTITION BY source, first ORDER BY level DESC) = 1),
b AS (
  SELECT doc_id, leaf, subroot, done.source, first, 0 AS level, s.pos, v, proof FROM done JOIN subroots s ON s.source IS NOT DISTINCT FROM done.source
  UNION ALL
  SELECT doc_id, leaf, subroot, source, first, b.level + 1, pos // 3,
    sha256(array_to_string(run[1 : pos % 3], '') || v || array_to_string(run[pos % 3 + 2 :], '')),
    proof || array_to_string(run[1 : pos % 3], '') || array_to_string(run[pos % 3 + 2 :], '')
  FROM b JOIN over_runs r ON r.level = b.level AND r.parent = b.pos // 3
), ended AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source, first ORDER BY level DESC) = 1),
top AS (SELECT digest AS root FROM over WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, v AS folded_root, v = root AS verified FROM ended, top
"""
