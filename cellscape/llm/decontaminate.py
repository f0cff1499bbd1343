"""Operator 7, benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words go into a suffix automaton (one state per class of substrings that end alike; each item
starts again at the root, so no match crosses items).  Every document streams its words through it; at each
word the automaton gives the longest run of words, ending there, that some item contains.  A run as long as the
window is an occurrence of a window, and its words are hit; the span's items are kept with the state.
An item shorter than the window is one window of its own.

The item table is cut into blocks of `block_bytes` bytes (and one item), one automaton each, of which the driver and the
workers hold one at a time.  With one block, documents are read once and never move.  With several, documents are numbered
and read once for each block; only spans are kept, and limits are applied once, to the union of a document's spans over all blocks.

Cases: null texts have no words; items without words have no window; repeated items count once per item_id; repeated
documents are separate rows; long texts are streamed whole through the automaton; equal windows of several items (ties) count for
all of them; empty tables give no hits.  Null item ids are listed as the empty string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.llm.common import free_name, in_arrow, may_be_in, prefix_sums, slices, stored, table, texts_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of every window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        lists = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items]
        for _, words in lists:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.shortest = min((min(len(words), window) for _, words in lists if words), default=window)
        self.owners: dict[int, set[str]] = {}
        self.whole: dict[int, dict[int, set[str]]] = {}
        for item, words in lists:
            state = 0
            for w in words:
                state = self.next[state][w]
                if len(words) >= window and (at := self._of_length(state, window)) is not None:
                    self.owners.setdefault(at, set()).add(item)
            if words and len(words) < window:
                self.whole.setdefault(state, {}).setdefault(len(words), set()).add(item)
        self.up = [self._of_length(s, window) for s in range(len(self.next))]
        self.short = [self._shorts(s) for s in range(len(self.next))] if self.whole else []

    def _extend(self, last: int, w: int) -> int:
        if (to := self.next[last].get(w)) is not None:
            if self.length[to] == self.length[last] + 1:
                return to
            return self._split(last, to, w)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            to = self.next[p][w]
            self.link[new] = to if self.length[to] == self.length[p] + 1 else self._split(p, to, w)
        return new

    def _state(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, to: int, w: int) -> int:
        twin = self._state(dict(self.next[to]), self.length[p] + 1, self.link[to])
        self.link[to] = twin
        while p != -1 and self.next[p].get(w) == to:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _of_length(self, s: int, n: int) -> int | None:
        """The state of the last n words of s's substrings, if they are that long."""
        if self.length[s] < n:
            return None
        while self.length[self.link[s]] >= n:
            s = self.link[s]
        return s

    def _shorts(self, s: int) -> list[tuple[int, set[str]]]:
        found = []
        while s > 0:
            found += self.whole.get(s, {}).items()
            s = self.link[s]
        return found

    def longest(self, numbers: list[int]) -> Iterator[tuple[int, int]]:
        """For each word number: the state and the length of the longest match that ends there."""
        state, n = 0, 0
        for w in numbers:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                state, n = 0, 0
            yield state, n

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans (start, end) of occurring windows, and the items that have those windows."""
        get = self.ids.get
        numbers = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate([[False], numbers >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        spans, items, states = [], set(), set()
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a < self.shortest:
                continue
            for j, (state, n) in enumerate(self.longest(numbers[a:b].tolist()), a + 1):
                if n >= self.window:
                    spans.append((j - self.window, j))
                    states.add(self.up[state])
                if self.short:
                    for k, found in self.short[state]:
                        if k <= n:
                            spans.append((j - k, j))
                            items |= found
        for s in states:
            items |= self.owners.get(s, set())
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, list[int]]:
    """(block, item, text) of the items, stored, and the numbers of the blocks."""
    rows = stored(items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("row", 33)).withColumn("bytes", F.octet_length("text") + 1)
    placed = prefix_sums(rows, [], "part", [F.col("row")], "bytes", "before")
    blocks = stored(placed.select(F.floor(F.col("before") / block_bytes).alias("block"), "item", "text"))
    return blocks, sorted(r[0] for r in blocks.select("block").distinct().collect())


def block_of(blocks: DataFrame, number: int) -> list[tuple[str, list[bytes]]]:
    return [(item, words_of(text.encode())) for item, text in blocks.filter(F.col("block") == number).select("item", "text").collect()]


_built: dict = {}


def _automaton(shared, window: int) -> Automaton:
    """The automaton of a broadcast block, built once in a worker."""
    if shared.value is not _built.get("block") or _built.get("window") != window:
        _built.clear()
        _built.update(block=shared.value, window=window, automaton=Automaton(shared.value, window))
    return _built["automaton"]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def spans_in_blocks(docs: DataFrame, row: str, text_col: str, blocks: DataFrame, numbers: list[int], window: int) -> DataFrame:
    """(row, spans, items) of the rows with hits in any block; row is a column of docs that numbers its rows."""
    rows, parts = docs.select(F.col(row).alias("row"), F.col(text_col).alias("text")), []
    for number in numbers:
        shared = docs.sparkSession.sparkContext.broadcast(block_of(blocks, number))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared, window)
            for b in slices(batches):
                found = [automaton.spans(words_of(t)) for t in texts_of(b.column(1))]
                spans = [[{"start": x, "stop": y} for x, y in merged(f)] for f, _ in found]
                out = pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS), pa.array([sorted(i) for _, i in found], pa.list_(pa.string()))], names=["row", "spans", "items"])
                yield out.filter(pa.array([bool(f) for f, _ in found], pa.bool_()))

        parts.append(stored(in_arrow(rows, run, "row long, spans array<struct<start:long,stop:long>>, items array<string>")))
        shared.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _hits(docs: DataFrame, items: DataFrame, text_col: str, window: int, block_bytes: int, item_id: str, item_text: str):
    """(rows, own, find): docs with what find needs, and the number of docs' own columns, which come first.

    find(batch, texts) gives for each text of an Arrow batch of rows its words' number, its merged spans and its items.
    """
    blocks, numbers = item_blocks(items, item_id, item_text, block_bytes)
    own = len(docs.columns)
    if len(numbers) <= 1:
        shared = docs.sparkSession.sparkContext.broadcast(block_of(blocks, numbers[0]) if numbers else [])

        def scan(b: pa.RecordBatch, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
            automaton = _automaton(shared, window)
            for text in texts:
                words = words_of(text)
                spans, found = automaton.spans(words)
                yield len(words), merged(spans), sorted(found)

        return docs, own, scan
    row, spans, of = (free_name(docs, n) for n in ("row", "spans", "items"))
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    hit = stored(spans_in_blocks(docs, row, text_col, blocks, numbers, window).select(F.col("row").alias(row), F.col("spans").alias(spans), F.col("items").alias(of)))
    # Rows outside the filter have no hits and don't move.
    may_hit = may_be_in(hit.select(row))(F.col(row))
    plain = docs.filter(~may_hit).withColumn(spans, F.lit(None).cast(hit.schema[spans].dataType)).withColumn(of, F.lit(None).cast("array<string>"))
    rows = plain.unionByName(docs.filter(may_hit).join(hit, row, "left"))
    rows = rows.select(*[c for c in docs.columns if c != row], spans, of)

    def given(b: pa.RecordBatch, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        for text, held, found in zip(texts, b.column(own).to_pylist(), b.column(own + 1).to_pylist()):
            yield len(words_of(text)), merged([(x["start"], x["stop"]) for x in held or []]), sorted(found or [])

    return rows, own, given


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, block_bytes: int = 1 << 19, max_coverage: float = 0.5, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, clean, n_words, n_hit, items, contaminated, removed): every row with its hit words cut out.

    A document of which more than max_coverage of its words are hit is removed whole (clean is null, removed is true);
    of any other, the bytes from the first to the last hit word of each span go.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(given.dtypes)["id"]
    rows, _, find = _hits(given, items, "text", window, block_bytes, item_id, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = texts_of(b.column(1))
            n, spans, found = (list(x) for x in zip(*find(b, texts)))
            hit = [sum(y - x for x, y in s) for s in spans]
            removed = [k > max_coverage * m for k, m in zip(hit, n)]
            clean = [None if gone else (cut_spans(t, s) if s else t).decode() for t, s, gone in zip(texts, spans, removed)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.string()), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array([k > 0 for k in hit]), pa.array(removed)], names=[id_col, "clean", "n_words", "n_hit", "items", "contaminated", "removed"])

    return in_arrow(rows, run, f"`{id_col}` {kind}, clean string, n_words long, n_hit long, items array<string>, contaminated boolean, removed boolean")


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    places = [m.span() for m in WORD.finditer(text.lower())]
    at, kept = 0, []
    for x, y in spans:
        kept.append(text[at : places[x][0]])
        at = places[y - 1][1]
    return b"".join([*kept, text[at:]])


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = 10, block_bytes: int = 1 << 19, max_coverage: float = 0.5, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs with hit spans cut out of the text; rows hit on more than max_coverage of their words go.

    All other columns stay as they are.
    """
    at, schema = docs.columns.index(text_col), docs.schema
    rows, own, find = _hits(docs, items, text_col, window, block_bytes, item_id, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            texts, keep = b.column(at).to_pylist(), []
            raw = texts_of(b.column(at))
            for i, (n, spans, _) in enumerate(find(b, raw)):
                keep.append(sum(y - x for x, y in spans) <= max_coverage * n)
                if spans and keep[-1]:
                    texts[i] = cut_spans(raw[i], spans).decode()
            whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(own)], names=schema.names)
            yield whole.filter(pa.array(keep, pa.bool_()))

    return in_arrow(rows, run, schema)


def op7_decontamination(spark, sf_dir: str, window: int = 10) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=window)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated", "removed")


# In DuckDB: positions of each document's words, equal 10-word (or whole short) windows, and the words they cover.
SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, least(len(w), 10) AS k, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS t FROM iw WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM win),
dwin AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest([array_to_string(w[j:j + k - 1], ' ') FOR j IN range(1, len(w) - k + 2)]) AS t FROM dw, ks WHERE len(w) >= k
), occ AS (SELECT d.doc_id, d.k, d.i, x.item_id FROM dwin d JOIN win x ON d.k = x.k AND d.t = x.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(hit.n, 0) > 0.5 * len(d.w) AS removed
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
