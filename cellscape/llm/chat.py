"""Operator 3, chat formatting: a hidden Markov model over marker and line features recovers roles, then turns are rendered.

A row's text is cut where a line starts with a speaker marker; the pieces are the model's steps.  A piece's features are its
marker, whether it starts a row, its words, lines, final question mark and code fence.  Transition and feature
probabilities are counted from rows whose role is known; roles are never read when pieces are decoded.

A marker is dropped only where its role is the decoded one: a line of an answer that happens to begin with a speaker's name stays, and the turn
goes on.

Viterbi decoding is a max-plus matrix product, which is associative.  `width` consecutive pieces of a conversation are
one block with one matrix, whatever their turn numbers; blocks of blocks are combined level by level, and the best states at the borders are handed down
again.  A conversation of any length is thus many small tasks, and no conversation is gathered into one.

Cases: null texts are empty and make one piece; rows without a turn come first; equal turn numbers are ordered by a hash of the text;
repeated rows are rows of their own; null conv_ids are one conversation; unknown roles teach nothing; long texts are cut and
rendered whole, one piece at least; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellscape.llm.common import fold, in_arrow, prefix_sums, stored, table

ROLES = ("system", "user", "assistant", "tool")
#: Speaker words and the role each names.
SPEAKERS = {"system": "system", "user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "tool": "tool", "function": "tool"}
MARKER = r"[ \t]*(?:#+[ \t]*|<\|)?(" + "|".join(SPEAKERS) + r")(?:\|>|[ \t]*:)[ \t]*"
#: Values of each feature, in the order of their digits in a piece's code.
SIZES = (len(ROLES) + 1, 2, 10, 4, 2, 2)


def cut_text(text: Column) -> Column:
    """A text's pieces, each but the first from a marker at the start of a line on; together they are the text."""
    return F.split(F.coalesce(text, F.lit("")), rf"(?im)(?=^{MARKER})")


def bare(raw: Column) -> Column:
    """A piece without its marker and the blanks around it."""
    return F.btrim(F.regexp_replace(raw, rf"(?i)^{MARKER}", ""), F.lit(" \t\r\n"))


def pieces(rows: DataFrame) -> DataFrame:
    """(src, conv, turn, given, tie, piece, marker, code, raw) of rows (src, conv, turn, given, text): one row a piece.

    src numbers the rows; tie, a hash of the row's text, orders rows of one turn.
    """
    cut = rows.select("src", "conv", "turn", "given", F.xxhash64("text").alias("tie"), F.posexplode(cut_text(F.col("text"))).alias("piece", "raw"))
    word = F.lower(F.regexp_extract("raw", rf"(?i)^{MARKER}", 1))
    marker = F.lit(0)
    for speaker, role in SPEAKERS.items():
        marker = F.when(word == speaker, ROLES.index(role) + 1).otherwise(marker)
    cut = cut.withColumns({"marker": marker, "body": bare(F.col("raw"))})
    words = F.size(F.split("body", r"\s+"))
    digits = [
        F.col("marker"),
        (F.col("piece") == 0).cast("int"),
        F.least(F.lit(SIZES[2] - 1), F.floor(F.log2(words + 1.0))).cast("int"),
        F.least(F.lit(SIZES[3] - 1), F.size(F.split("body", "\n")) - 1),
        F.col("body").endswith("?").cast("int"),
        F.col("body").contains("```").cast("int"),
    ]
    code = F.lit(0)
    for d, n in zip(digits, SIZES):
        code = code * n + d
    return cut.select("src", "conv", "turn", "given", "tie", "piece", "marker", code.alias("code"), "raw")


def features_of(codes: np.ndarray) -> np.ndarray:
    """The digits of piece codes, one row a code."""
    out = np.empty((len(codes), len(SIZES)), np.int64)
    for k in range(len(SIZES) - 1, -1, -1):
        codes, out[:, k] = np.divmod(codes, SIZES[k])
    return out


class Hmm:
    """Log probabilities; the state after the roles is the one before a conversation starts."""

    def __init__(self, moves: np.ndarray, features: list[np.ndarray]):
        self.moves, self.features = moves, features

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        digits = features_of(codes)
        return sum(f[:, digits[:, k]].T for k, f in enumerate(self.features))

    def steps(self, codes: np.ndarray) -> np.ndarray:
        """One max-plus matrix for each piece: from the state before it to its own."""
        k = len(ROLES)
        out = np.full((len(codes), k + 1, k + 1), -np.inf)
        out[:, :, :k] = self.moves[None] + self.emissions(codes)[:, None, :]
        return out


def product(steps: np.ndarray) -> np.ndarray:
    out = steps[0]
    for m in steps[1:]:
        out = (out[:, :, None] + m[None]).max(axis=1)
    return out


def path(steps: np.ndarray, first: int, last: int) -> list[int]:
    """Best states after each step, from state `first`, ending in `last`."""
    score, back = steps[0][first], []
    for m in steps[1:]:
        both = score[:, None] + m
        back.append(both.argmax(axis=0))
        score = both.max(axis=0)
    out = [last]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def fit(blocks: DataFrame, smooth: float = 0.5) -> Hmm:
    """Count moves and features over rows (conv, block, items) with known roles; numbers of a fixed count reach the driver."""
    k = len(ROLES)
    roles = F.array(*map(F.lit, ROLES))
    each = blocks.select("conv", "block", F.posexplode("items").alias("at", "item"))
    each = each.select("conv", "block", "at", (F.array_position(roles, F.col("item.given")) - 1).alias("role"), F.col("item.code").alias("code"))
    last = blocks.select("conv", (F.col("block") + 1).alias("block"), (F.array_position(roles, F.element_at("items", -1)["given"]) - 1).alias("before"))
    here = W.partitionBy("conv", "block").orderBy("at")
    each = each.withColumn("lagged", F.lag("role").over(here))
    joined = each.alias("e").join(last.alias("l"), F.col("e.conv").eqNullSafe(F.col("l.conv")) & (F.col("e.block") == F.col("l.block")) & (F.col("e.at") == 0), "left")
    joined = joined.select("e.role", "e.code", F.when(F.col("e.at") > 0, F.col("e.lagged")).otherwise(F.coalesce("l.before", F.lit(k))).alias("from"))
    got = joined.filter("role >= 0 and from >= 0").groupBy("from", "role", "code").agg(F.count("*").alias("n")).toPandas()
    moves, features = np.full((k + 1, k), smooth), [np.full((k, n), smooth) for n in SIZES]
    if len(got):
        np.add.at(moves, (got["from"], got["role"]), got["n"])
        digits = features_of(got["code"].to_numpy().astype(np.int64))
        for j, f in enumerate(features):
            np.add.at(f, (got["role"], digits[:, j]), got["n"])
    log = lambda x: np.log(x / x.sum(axis=1, keepdims=True))
    return Hmm(log(moves), [log(f) for f in features])


def decode(blocks: DataFrame, model: Hmm, width: int = 64) -> DataFrame:
    """(row, role) of the pieces of stored blocks (conv, block, items)."""
    size = len(ROLES) + 1
    kind = dict(blocks.dtypes)["conv"]

    def matrices(leaf: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for held in b.column(2):
                    steps = model.steps(np.asarray(held.values, np.int64)) if leaf else np.asarray(held.values.flatten()).reshape(-1, size, size)
                    out.append(product(steps).ravel())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], names=["conv", "block", "m"])

        return run

    schema = f"conv {kind}, block long, m array<double>"
    current = in_arrow(blocks.select("conv", "block", F.transform("items", lambda i: i["code"]).alias("codes")), matrices(True), schema)
    levels, most = [], blocks.agg(F.max("block")).first()[0] or 0
    while True:
        grouped = stored(current.groupBy("conv", F.floor(F.col("block") / width).alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("items")))
        levels.append(grouped)
        most //= width
        if not most:
            break
        current = in_arrow(grouped.select("conv", "block", F.transform("items", lambda i: i["m"]).alias("ms")), matrices(False), schema)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each group with its first and last state: those of its members."""
        for b in batches:
            conv, block, first, last = [], [], [], []
            for i in range(b.num_rows):
                start, end = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                steps = np.asarray(b.column(5)[i].values.flatten()).reshape(-1, size, size)
                if end is None:
                    end = int(product(steps)[start].argmax())
                states = path(steps, start, end)
                conv += [i] * len(states)
                block += b.column(4)[i].as_py()
                first += [start, *states[:-1]]
                last += states
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(conv, pa.int64())), pa.array(block, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["conv", "block", "first", "last"])

    split = [F.transform("items", lambda i: i["block"]).alias("blocks"), F.transform("items", lambda i: i["m"]).alias("ms")]
    known = in_arrow(levels[-1].select("conv", "block", F.lit(len(ROLES)).alias("first"), F.lit(None).cast("int").alias("last"), *split), borders, f"conv {kind}, block long, first int, last int")
    for level in reversed(levels[:-1]):
        given = _with_states(level, known)
        known = in_arrow(given.select("conv", "block", "first", "last", *split), borders, f"conv {kind}, block long, first int, last int")

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [path(model.steps(np.asarray(codes.values, np.int64)), f, x) for codes, f, x in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["conv", "block", "states"])

    leaves = _with_states(blocks.select("conv", "block", F.transform("items", lambda i: i["code"]).alias("codes")), known)
    found = in_arrow(leaves.select("conv", "block", "codes", "first", "last"), states, f"conv {kind}, block long, states array<int>")
    rows = blocks.select("conv", "block", F.transform("items", lambda i: i["row"]).alias("rows"))
    both = rows.alias("b").join(found.alias("f"), F.col("b.conv").eqNullSafe(F.col("f.conv")) & (F.col("b.block") == F.col("f.block"))).select(F.explode(F.arrays_zip("b.rows", "f.states")).alias("z"))
    return both.select(F.col("z.rows").alias("row"), F.array(*map(F.lit, ROLES))[F.col("z.states")].alias("role"))


def _with_states(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.alias("r").join(known.alias("k"), F.col("r.conv").eqNullSafe(F.col("k.conv")) & (F.col("r.block") == F.col("k.block"))).select("r.*", "k.first", "k.last")


def rendered(role: str, body: str) -> Column:
    """A canonical turn.  In the body, "<" and any backslashes before "|" get one backslash more, so a body holds no mark and can be read back."""
    safe = F.regexp_replace(F.col(body), r"<(\\*)\|", r"<\\$1|")
    return F.concat(F.lit("<|"), F.col(role), F.lit("|>\n"), safe, F.lit("\n<|end|>\n"))


def numbered(found: DataFrame) -> DataFrame:
    return found.withColumn("row", F.monotonically_increasing_id())


def cut_blocks(found: DataFrame, width: int, most: int = 50_000) -> DataFrame:
    """(conv, block, items) of numbered pieces: block k has a conversation's pieces of ranks k * width on, by turn, text and piece.
    Items carry a piece's number instead of its text, so texts don't move.

    Ranks are two-level prefix sums over parts of a conversation.  A part is a range of turns; where a range has more than
    `most` pieces, one turn and a range of the texts' hashes; where that has more (copies), one text and a slice of rows.
    """
    found = found.select("conv", "turn", "given", "tie", "src", "piece", "code", "row")
    found = found.withColumn("range", F.floor(F.col("turn") / 64)).withColumn("near", F.shiftright("tie", 52))
    for keys, name in ((["conv", "range"], "wide"), (["conv", "turn", "near"], "same")):
        # At most one row for every `most` pieces.
        large = found.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias(name))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        found = found.join(large, on, "left").drop(*[f"_{k}" for k in keys]).withColumn(name, F.coalesce(name, F.lit(False)))
    wide, same = F.col("wide"), F.col("wide") & F.col("same")
    levels = [F.col("range"), F.when(wide, F.col("turn")), F.when(wide, F.col("near")), F.when(same, F.col("tie")), F.when(same, F.shiftright("src", 14))]
    found = found.withColumn("part", F.struct(*[x.alias(f"l{i}") for i, x in enumerate(levels)])).withColumn("one", F.lit(1))
    order = ["turn", "tie", "src", "piece"]
    ranked = prefix_sums(found.drop("range", "near", "wide", "same"), ["conv"], "part", [F.col(k) for k in order], "one", "rank")
    item = F.struct("rank", "given", "code", "row")
    return ranked.groupBy("conv", F.floor(F.col("rank") / width).alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))


def turns(raws: Column, roles: Column, markers: Column) -> Column:
    """array<piece, role, body> of a row's pieces and what was decoded for them.

    A turn begins with the row, where the role changes, and at a marker of the decoded role; that marker is not part of the body.  A marker of
    another role is text, and stays; so do the lines after it.
    """
    meant = lambda i: F.get(markers, i) == F.get(roles, i) + 1
    begins = F.filter(F.sequence(F.lit(0), F.size(raws) - 1), lambda i: (i == 0) | meant(i) | (F.get(roles, i) != F.get(roles, i - 1)))

    def cut(begins: Column) -> Column:
        def turn(i: Column, k: Column) -> Column:
            end = F.coalesce(F.get(begins, k + 1), F.size(raws))
            first = F.when(meant(i), bare(F.get(raws, i))).otherwise(F.get(raws, i))
            # A marker's piece that others follow keeps the blanks before them.
            first = F.when(meant(i) & (end > i + 1), F.regexp_replace(F.get(raws, i), rf"(?i)^{MARKER}", "")).otherwise(first)
            body = F.btrim(F.array_join(F.concat(F.array(first), F.slice(raws, i + 2, end - i - 1)), ""), F.lit(" \t\r\n"))
            return F.struct(i.alias("piece"), F.array(*map(F.lit, ROLES))[F.get(roles, i)].alias("role"), body.alias("body"))

        return F.transform(begins, turn)

    return F.transform(F.array(begins), cut)[0]


def parse_transcripts(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role", training: Column | None = None, width: int = 64) -> DataFrame:
    """(conv_id, turn, piece, given, role, turn_text): the turns of every row, `piece` being a turn's first piece; learns from the rows where
    `training` holds (a column over conv).

    Pieces travel as numbers; texts move once, to the roles of their pieces.
    """
    given = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.lower(F.col(role_col)).alias("given"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = stored(given.withColumn("src", F.monotonically_increasing_id()))
    found = stored(numbered(pieces(texts).drop("raw")))
    blocks = stored(cut_blocks(found, width))
    model = fit(blocks.filter(F.lit(True) if training is None else training))
    index = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
    decoded = found.select("row", "src", "piece", "marker").join(decode(blocks, model, width), "row")
    of = decoded.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("piece", index.alias("role"), "marker"))).alias("x"))
    met = texts.join(of, "src").select("conv", "turn", "given", cut_text(F.col("text")).alias("raws"), F.col("x.role").alias("roles"), F.col("x.marker").alias("markers"))
    out = met.select("conv", "turn", "given", F.explode(turns(F.col("raws"), F.col("roles"), F.col("markers"))).alias("t")).select("conv", "turn", "given", "t.*")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "piece", "given", "role", rendered("role", "body").alias("turn_text"))


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    out = parse_transcripts(table(spark, sf_dir, "conversations"), training=fold("conv", 10) != 0)
    return out.select("conv_id", "turn", "piece", (fold("conv_id", 10) == 0).alias("held_out"), "given", "role", "turn_text")
