"""Operator 9, language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting: each task counts its unigrams and bigrams by 64-bit fingerprint, Spark sums them over all training rows.
An n-gram of level q (its count is in [2^(q-1), 2^q)) is in the filter q times, as (n-gram, 1) .. (n-gram, q), each by
`hashes` bits; a reader probes level after level until one is missing.
The filter has four bits for every bit that the counted n-grams set, and `most_bits` at most, so what is
broadcast has a bound.  Levels are admitted from the highest down, unigrams before bigrams of up
to three levels more, as long as it stays half empty: a probe for what is not there then succeeds with probability
2 ** -hashes at most, and one in 300 while the filter has room.  The n-grams of all lower levels, those seen once included, stay in the table
of counts, and what the filter lacks is joined with it: the model is the same whatever the filter's size.

The model: P(w | v) = back * P(w) + (1 - back) * c(v, w) / c(v), with P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), counts
from the levels (a level's count is its middle), and c(start) the number of texts; without c(v), P(w) alone.  Quantised
counts make c(v, w) / c(v) a rounded share, cut at 1, so the probabilities after one word need not sum to 1: scores
compare texts under one model and are no exact code lengths.

The exact base score does not use the filter: counts of the commonest tokens (at most `most_frequent`) are a broadcast
table, all others are joined.  Tokens are identified by xxh64.

Cases: a null or empty text has the end token only; repeated rows are separate rows and count as often as they stand; long
texts are counted and scored whole; n-grams of equal count (ties) are of one level and fare alike; an empty table gives an empty
one; without training tokens every base probability is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.llm.common import WordHash, fold, in_arrow, may_be_in, mixed, slices, stored, table, texts_of

#: No word has white space, so these are no words' fingerprints but by accident.
END, START = xxhash.xxh64_intdigest(b" "), xxhash.xxh64_intdigest(b"\n")
SEGMENTS = 64
#: Stands for the level of START, which every text has before its first token.
BEGIN = 99
_words = WordHash()


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all tokens, end tokens included, and the number of each text's tokens."""
    parts, n = [], []
    for text in texts:
        words = text.lower().split()
        words.append(b" ")
        parts.append(_words.of(words))
        n.append(len(words))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(n, np.int64)


def bigrams_of(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's predecessor (START at a text's first token), and the bigrams' fingerprints."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(n) - n] = START
    return before, mixed(before * np.uint64(0x9E3779B97F4A7C15) + tokens, 1)


def keyed(x: np.ndarray, kind: int) -> np.ndarray:
    """Fingerprints as keys whose lowest bit says the kind: 0 unigram, 1 bigram."""
    return (x & ~np.uint64(1)) | np.uint64(kind)


def ngram_counts(rows: DataFrame, flush: int = 4_000_000) -> DataFrame:
    """(h, c): counts of all n-grams of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(h), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 500_000].view(np.int64)), pa.array(c[at : at + 500_000].astype(np.int64))], names=["h", "c"])

        for b in slices(batches):
            tokens, n = tokens_of(texts_of(b.column(0)))
            held += [keyed(tokens, 0), keyed(bigrams_of(tokens, n)[1], 1)]
            size += 2 * len(tokens)
            if size >= flush:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    # Dealt by key first: the tasks' counts are already summed, a second map-side sum would find little.
    return in_arrow(rows, run, "h long, c long").repartition(F.col("h")).groupBy("h").agg(F.sum("c").alias("c"))


def level_of(c: Column) -> Column:
    return (F.floor(F.log2(c.cast("double") + 1e-9)) + 1).cast("int")


class Filter:
    """A log-frequency Bloom filter read by probing; one byte array, in segments by the key's high bits and blocks of 512 bits.

    The bits of one key at one level lie in one block, so a probe touches one place of memory.
    """

    def __init__(self, data: bytes, bits: int, hashes: int):
        self.data, self.hashes, self.segment = np.frombuffer(data, np.uint8), hashes, bits // SEGMENTS

    @staticmethod
    def places(keys: np.ndarray, level: int, hashes: int, segment: int) -> Iterator[np.ndarray]:
        """Bit places inside the keys' segments, one array a hash."""
        m = mixed(keys, 1000 + level)
        block = ((m >> np.uint64(36)) % np.uint64(segment // 512)) << np.uint64(9)
        for i in range(hashes):
            if i % 4 == 0 and i:
                m = mixed(m, i)
            yield block | ((m >> np.uint64(9 * (i % 4))) & np.uint64(511))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
        level = 1
        # No count of 64 bits has a level above 64; a filter whose segment is full would have no end.
        while len(alive) and level <= 64:
            k = keys[alive]
            first, held = (k >> np.uint64(58)) * np.uint64(self.segment), np.ones(len(k), np.uint8)
            for at in self.places(k, level, self.hashes, self.segment):
                at = at + first
                held &= self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
            alive = alive[(held & 1).astype(bool)]
            out[alive] = level
            level += 1
        return out


def build_filter(counts: DataFrame, bits: int, hashes: int) -> bytes:
    """The filter's bytes for rows (h, q): every admitted key's levels 1..q."""
    segment = bits // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            keys, q = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            of = (keys >> np.uint64(58)).astype(np.int64)
            for s in np.unique(of):
                data = held.setdefault(int(s), np.zeros(segment // 8, np.uint8))
                own, levels = keys[of == s], q[of == s]
                for level in range(1, int(levels.max(initial=0)) + 1):
                    k = own[levels >= level]
                    for at in Filter.places(k, level, hashes, segment):
                        np.bitwise_or.at(data, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["s", "data"])

    dealt = counts.repartition(SEGMENTS, F.shiftrightunsigned(F.col("h"), 58))
    data = np.zeros(bits // 8, np.uint8)
    for s, part in in_arrow(dealt.select("h", "q"), run, "s int, data binary").collect():
        data[s * segment // 8 : (s + 1) * segment // 8] |= np.frombuffer(part, np.uint8)
    return data.tobytes()


class Model:
    """What the workers need: the filter and its lowest levels by kind, the frequent tokens' exact counts, N, V and the number of texts."""

    def __init__(self, data: bytes, bits: int, hashes: int, least: tuple[int, int], frequent: np.ndarray, counts: np.ndarray, n: int, v: int, n_texts: int, back: float):
        self.filter, self.least, self.frequent, self.counts = Filter(data, bits, hashes), least, frequent, counts
        self.n, self.v, self.back = n, v, back
        self.total = n + 0.1 * (v + 1)
        self.begin = float(n_texts)

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Levels of the n-grams in the filter, 0 for all others; lower ones than the kind's lowest are accidents."""
        q = self.filter.levels(keys)
        q[q < self.least[kind]] = 0
        return q

    def log_p(self, w: np.ndarray, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """log10 P of tokens of level w after tokens of level v, as pairs of level q."""
        middle = lambda x: np.where(x > 0, 0.75 * np.exp2(x), 0.0)
        of = np.where(v == BEGIN, self.begin, middle(v))
        p = (middle(w) + 0.1) / self.total
        ratio = np.divide(middle(q), of, out=np.zeros(len(of)), where=of > 0)
        return np.log10(np.where(of > 0, self.back * p + (1 - self.back) * np.minimum(1.0, ratio), p))

    def log_p_of(self, w: Column, v: Column, q: Column) -> Column:
        """The same of columns."""
        middle = lambda x: F.when(x > 0, 0.75 * F.pow(F.lit(2.0), x)).otherwise(0.0)
        of = F.when(v == BEGIN, self.begin).otherwise(middle(v))
        p = (middle(w) + 0.1) / F.lit(self.total)
        return F.log10(F.when(of > 0, self.back * p + (1 - self.back) * F.least(F.lit(1.0), middle(q) / of)).otherwise(p))

    def model_scores(self, tokens: np.ndarray, n: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """(terms, parts, alone, lacking) of texts of n tokens each, of which `counted` were counted: log10 P of each token, with pairs that
        the filter lacks as unseen and 0 where it lacks a token's level; keys and levels; places that lack the pair alone; places
        that lack a token's level."""
        distinct, at = np.unique(tokens, return_inverse=True)
        seen = np.repeat(counted, n)
        w = self.levels(keyed(distinct, 0), 0)[at]
        if self.least[0] == 2:
            w[(w == 0) & seen] = 1
        starts = np.cumsum(n) - n
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[starts] = BEGIN
        before, h = bigrams_of(tokens, n)
        h = keyed(h, 1)
        q = self.levels(h, 1)
        if self.least[1] == 2:
            q[(q == 0) & seen] = 1
        terms = self.log_p(w, v, q)
        parts = {"w": keyed(tokens, 0), "wq": w, "v": keyed(before, 0), "vq": v, "h": h, "hq": q}
        lacking = (w == 0) | (v == 0) if self.least[0] > 1 else np.zeros(len(w), bool)
        terms[lacking] = 0.0
        alone = ~lacking & (q == 0) if self.least[1] > 1 else np.zeros(len(w), bool)
        return terms, parts, np.flatnonzero(alone), np.flatnonzero(lacking)


def listed(places: np.ndarray, starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Values of tokens at ascending places as one list a text; texts start at `starts`."""
    lengths = np.bincount(np.searchsorted(starts, places, side="right") - 1, minlength=len(starts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


def fields(**columns: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int32)) for x in columns.values()], names=list(columns))


def lowest_levels(sums: dict[tuple[int, int], int], room: int) -> tuple[int, int]:
    """Of unigrams and of bigrams, the lowest level that is admitted; sums has the number of n-grams by (kind, level).

    A unigram that is missing sends two tokens to the join, a bigram one with less: unigrams go three levels ahead.
    """
    least = {0: 99, 1: 99}
    for kind, q in sorted(sums, key=lambda x: (-x[1] - 3 * (x[0] == 0), x[0])):
        room -= sums[kind, q] * q
        if room < 0:
            break
        least[kind] = q
    else:
        return 1, 1
    return least[0], least[1]


def fit(rows: DataFrame, most_bits: int, hashes: int, most_frequent: int, back: float) -> tuple[Model, DataFrame, int]:
    """The model, the stored exact counts (h, c, kind, q) of all n-grams, and the level below which tokens are not in the broadcast table."""
    counts = ngram_counts(rows)
    kind = F.col("h").bitwiseAND(F.lit(1)).cast("int")
    counts = stored(counts.select("h", "c", kind.alias("kind"), level_of(F.col("c")).alias("q")))
    sums = counts.groupBy("kind", "q").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    n, v = sum(r.c for r in sums if r.kind == 0), sum(r.n for r in sums if r.kind == 0)
    end = counts.filter(F.col("h") == F.lit(int(keyed(np.array([END], np.uint64), 0).view(np.int64)[0]))).first()
    bits = min(most_bits, 1 << 24)
    while bits < min(most_bits, 4 * hashes * sum(r.n * r.q for r in sums)):
        bits *= 2
    bits = max(bits, SEGMENTS * 512)
    least = lowest_levels({(r.kind, r.q): r.n for r in sums}, int(min(bits, most_bits) * 0.69 / hashes))
    data = build_filter(counts.filter(F.col("q") >= F.when(F.col("kind") == 0, least[0]).otherwise(least[1])), bits, hashes)
    left, known = most_frequent, 1
    for q in sorted({r.q for r in sums if r.kind == 0}, reverse=True):
        left -= sum(r.n for r in sums if r.kind == 0 and r.q == q)
        if left < 0:
            known = q + 1
            break
    top = counts.filter((F.col("kind") == 0) & (F.col("q") >= known)).select("h", "c").toArrow()
    h, c = (np.asarray(top.column(k).to_numpy()) for k in ("h", "c"))
    order = np.argsort(h.view(np.uint64))
    return Model(data, bits, hashes, least, h.view(np.uint64)[order], c[order], int(n), int(v), int(end.c) if end else 0, back), counts, known


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Column | None = None, most_bits: int = 1 << 28, hashes: int = 4, most_frequent: int = 500_000, back: float = 0.5) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from the rows where `training` holds."""
    counted = F.coalesce(F.lit(True) if training is None else training, F.lit(False))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), counted.alias("counted"))
    spark = rows.sparkSession
    model, counts, known = fit(rows.filter("counted").select("text"), most_bits, hashes, most_frequent, back)
    shared = spark.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in slices(batches):
            tokens, n = tokens_of(texts_of(b.column(1)))
            starts = np.cumsum(n) - n
            terms, parts, alone, lacking = m.model_scores(tokens, n, b.column(2).to_numpy(zero_copy_only=False).astype(bool))
            own = np.add.reduceat(terms, starts)
            distinct, at = np.unique(keyed(tokens, 0), return_inverse=True)
            place = np.searchsorted(m.frequent, distinct)
            place[place == len(m.frequent)] = 0
            found = m.frequent[place] == distinct if len(m.frequent) else np.zeros(len(distinct), bool)
            value = np.where(found, np.log10(((m.counts[place] if len(m.counts) else 0) + 0.1) / m.total), 0.0)
            base = np.add.reduceat(value[at], starts)
            seen = np.add.reduceat(found[at].astype(np.int64), starts)
            rare = np.flatnonzero(~found[at])
            lists = [listed(rare, starts, pa.array(distinct[at[rare]].view(np.int64)))]
            lists.append(listed(alone, starts, fields(h=parts["h"][alone], both=parts["wq"][alone] + 128 * parts["vq"][alone])))
            lists.append(listed(lacking, starts, fields(**{k: x[lacking] for k, x in parts.items()})))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(seen), pa.array(base), pa.array(own), *lists], names=[id_col, "n_tokens", "seen", "base", "score", "rare", "alone", "lacking"])

    lists = "rare array<long>, alone array<struct<h:long,both:int>>, lacking array<struct<w:long,wq:int,v:long,vq:int,h:long,hq:int>>"
    first = stored(in_arrow(rows, run, f"`{id_col}` {kind}, n_tokens long, seen long, base double, score double, {lists}").withColumn("row", F.monotonically_increasing_id()))
    others = counts.filter((F.col("kind") == 0) & (F.col("q") < known)).select("h", "c")
    # All tokens missing from the broadcast table, met with their counts; unknown ones keep count 0.
    each = first.select("row", F.explode("rare").alias("h")).join(others, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    each = each.select("row", F.log10((F.col("c") + 0.1) / F.lit(model.total)).alias("base"), (F.col("c") > 0).cast("long").alias("met"), F.lit(0.0).alias("own"))
    if max(model.least) > 1:
        each = each.union(_lacking(first, counts, model).select("row", F.lit(0.0), F.lit(0).cast("long"), "own"))
    part = each.groupBy("row").agg(F.sum("base").alias("more"), F.sum("met").alias("met"), F.sum("own").alias("own"))
    out = first.drop("rare", "alone", "lacking").join(part, "row", "left")
    known_tokens, base = F.col("seen") + F.coalesce("met", F.lit(0)), F.col("base") + F.coalesce("more", F.lit(0.0))
    return out.select(id_col, "n_tokens", known_tokens.alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("own", F.lit(0.0))).alias("score"))


def _lacking(first: DataFrame, counts: DataFrame, model: Model, most_asked: int = 8_000_000) -> DataFrame:
    """(row, own): what the n-grams below the filter's lowest level add to the rows' scores."""
    lowest = F.when(F.col("kind") == 0, model.least[0]).otherwise(model.least[1])
    rest = counts.filter(F.col("q") < lowest).select(F.col("h").alias("key"), F.col("q").alias("got"))
    asked = first.select(F.explode(F.concat(F.transform("alone", lambda x: x["h"]), F.flatten(F.transform("lacking", lambda x: F.array(x["w"], x["v"], x["h"]))))).alias("h"))
    if (first.agg(F.sum(F.size("alone") + 3 * F.size("lacking"))).first()[0] or 0) <= most_asked:
        # Few n-grams are asked for: a filter over them keeps all others of the table from the joins.
        rest = rest.filter(may_be_in(asked)(F.col("key")))
    # Both levels stay packed through the join; pairs that training never saw drop out of it.
    alone = first.select("row", F.explode("alone").alias("x")).select("row", F.col("x.h").alias("key"), F.col("x.both").alias("both"))
    w, v = F.col("both") % 128, F.floor(F.col("both") / 128)
    alone = alone.join(rest, "key").select("row", (model.log_p_of(w, v, F.col("got")) - model.log_p_of(w, v, F.lit(0))).alias("own"))
    open_ = first.select("row", F.explode("lacking").alias("x")).select("row", "x.*")
    for key, level in (("w", "wq"), ("v", "vq"), ("h", "hq")):
        # A level that is known takes the pair as its key: no token has it, and no frequent token gathers rows.
        keyed_ = open_.withColumn("key", F.when(F.col(level) == 0, F.col(key)).otherwise(F.col("h")))
        got = F.when(F.col(level) == 0, F.coalesce("got", F.lit(0))).otherwise(F.col(level))
        open_ = keyed_.join(rest, "key", "left").withColumn(level, got).drop("key", "got")
    return alone.union(open_.select("row", model.log_p_of(F.col("wq"), F.col("vq"), F.col("hq"))))


def op9_lm_scores(spark, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 10) == 0
    out = score(table(spark, sf_dir, "documents"), training=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
