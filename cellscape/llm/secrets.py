r"""Operator 5, secret scans in DataFrame expressions only.

Base rules find assignments, access keys and hexadecimal runs.  The method adds strings that look random: two character
Markov models, one of random strings and one of ordinary identifiers, give each long run of letters, digits and +/_-=
a log-likelihood ratio; a run above the threshold that no base span touches is added as kind `markov`.
Both models are counted from labelled samples of the documents themselves: the values that base rules matched are label 1,
other long runs whose parts between separators are words, words with digits at their end, or digits are label 0.  Matched values are few, so a
random string may also be one of uniform characters: the ratio takes the likelier of both.

Steps that the samples hardly show back off to steps between classes of characters: identifiers keep to their class, repeat separators, and change
from small to capital letters or into digits seldom, random strings do so at random.  A run must be LEAST_ODDS times likelier
random than ordinary, which is the stated cost of marking an ordinary string.

Positions come from the matches and the pieces between them, so they are code points, end exclusive.

Cases: a null text is empty and has no spans (and stays null where secrets are replaced); repeated rows give repeated results; spans of
equal start (ties) are in the order of their kinds; long texts, and long runs, are searched whole in pieces; an empty table gives an empty
one; without any sample of a label its model is uniform.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.llm.common import stored, table

# The base rules.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

#: Long runs that the models judge, and their alphabet.
RUN = r"[A-Za-z0-9+/_=-]{16,}"
#: The log-likelihood ratio a character from which a run counts as random.
LEAST_RATIO = 0.0
#: A base value that teaches the model of random strings: long, of letters and digits; passwords that are words teach nothing.
RANDOM = "^(?=.*[0-9])(?=.*[A-Za-z]).{16,}$"
#: How many times likelier random than ordinary a run must be besides.
LEAST_ODDS = 100.0
#: A long run that teaches the identifier model: its parts are words, words with a few digits at their end, or digits.
ORDINARY = "^([A-Za-z]+[0-9]{0,4}|[0-9]{1,8}|[+/_=-]+)([+/_=-]+([A-Za-z]+[0-9]{0,4}|[0-9]{1,8}|$))*$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


#: Classes of characters, and what is believed of identifiers before any is seen: how often one class follows another (a line feed: the start).
CLASSES = {"small": ALPHABET[26:52], "capital": ALPHABET[:26], "digit": ALPHABET[52:62], "mark": ALPHABET[62:]}
#: Letters by how often they stand in words, in percent.
LETTERS = {"a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.15, "k": 0.8, "l": 4.0, "m": 2.4, "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.1, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 1.0, "w": 2.4, "x": 0.15, "y": 2.0, "z": 0.07}
STEPS = {
    "start": {"small": 0.60, "capital": 0.20, "digit": 0.05, "mark": 0.15},
    "small": {"small": 0.79, "capital": 0.09, "digit": 0.04, "mark": 0.08},
    "capital": {"small": 0.40, "capital": 0.50, "digit": 0.03, "mark": 0.07},
    "digit": {"small": 0.10, "capital": 0.05, "digit": 0.60, "mark": 0.25},
    "mark": {"small": 0.55, "capital": 0.15, "digit": 0.10, "mark": 0.20},
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """array<kind> of out(state, item), state being what step has made of `zero` and all earlier items.

    In chunks of 256 items: an array that grows by one is copied each time, so one level alone would be quadratic.
    """
    none = F.array().cast(f"array<{kind}>")

    def chunked(items: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / 256).cast("int")), lambda i: F.slice(items, i * 256 + 1, F.lit(256)))

    def walked(chunks: Column) -> Column:
        first = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(chunks, first, lambda acc, c: F.struct(F.aggregate(c, acc["at"], step).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(chunks, starts, inside))

    def inside(chunk: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(chunk, first, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(out(acc["at"], x))).alias("out")))["out"]

    return let(items, lambda x: F.when(F.size(x) > 0, let(chunked(x), walked)).otherwise(none))


SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def spans_of(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """array<struct<start,kind,stop,value>> of a pattern's matches, the value being the match's group.

    Positions are running sums of the lengths of matches and of the pieces between them.
    """

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
        values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        sizes = F.zip_with(gaps, F.transform(found, F.length), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        steps = F.zip_with(sizes, values, lambda x, v: F.struct(x["g"].alias("g"), x["m"].alias("m"), v.alias("v")))
        span = lambda at, x: F.struct((at + x["g"]).alias("start"), F.lit(kind).alias("kind"), (at + x["g"] + x["m"]).alias("stop"), x["v"].alias("value"))
        return running(steps, F.lit(0), lambda at, x: at + x["g"] + x["m"], span, SPAN)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(f"array<{SPAN}>")))


def base_spans(text: Column) -> list[Column]:
    """The base spans of each kind, in order."""
    assign = F.filter(spans_of(text, ASSIGN, 0, group=2), lambda s: F.length(s["value"]) >= LEAST["assign"])
    # A run of one class is matched whole and nothing inside it can match longer, so the length may stand in the pattern.
    access = spans_of(text, f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", 1)
    return [assign, access, spans_of(text, f"[0-9a-f]{{{LEAST['hex']},}}", 2)]


def touches(run: Column, spans: Column) -> Column:
    """Whether a run shares a place with one of the spans, which are in order and apart: the last that starts before the run's end
    decides, found by halving."""
    halves = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    first = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def half(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        before = F.get(spans, mid)["start"] < run["stop"]
        return F.when(acc["lo"] >= acc["hi"], acc).when(before, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

    upto = F.aggregate(halves, first, half)["lo"]
    return F.coalesce(F.get(spans, upto - 1)["stop"] > run["start"], F.lit(False))


def _apart_from(spans: Column) -> Callable[[Column], Column]:
    return lambda run: ~touches(run, spans)


def scanned(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(kept, base, runs) of every row: the columns `keep` as a struct, base spans by (start, kind), and the long runs that none touches.

    Stored: the models are counted from it and then judge it, and texts are searched once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = [c.alias(k) for k, c in zip(KINDS, base_spans(text))]
    rows = docs.select(F.struct(*keep).alias("kept"), *base, spans_of(text, RUN, 3).alias("long"))
    free = F.col("long")
    for k in KINDS[:3]:
        free = F.when(F.size(k) > 0, F.filter(free, _apart_from(F.col(k)))).otherwise(free)
    return stored(rows.select("kept", F.array_sort(F.concat(*KINDS[:3])).alias("base"), free.alias("runs")))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(label, a, b, n): how often character b follows a (a line feed before the first) in the labelled samples."""
    samples = rows.select(F.explode(F.concat(
        F.transform(F.filter("base", lambda s: s["value"].rlike(RANDOM)), lambda s: F.struct(F.lit(1).alias("label"), s["value"].alias("v"))),
        F.transform(F.filter("runs", lambda s: s["value"].rlike(ORDINARY)), lambda s: F.struct(F.lit(0).alias("label"), s["value"].alias("v"))),
    )).alias("s")).select("s.*")
    # Equal values are counted once each, so a copied secret does not weigh more: pre-aggregated by value.
    samples = samples.distinct()
    pairs = samples.select("label", F.explode(chunks_of(F.col("v"))).alias("v")).select("label", F.explode(neighbours(F.col("v"))).alias("p"))
    return pairs.groupBy("label", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def chunks_of(value: Column, size: int = 1 << 16) -> Column:
    """A text's pieces of `size` characters, each with the character before it and the first with a line feed."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / size).cast("int")), lambda i: F.substring(F.concat(F.lit("\n"), value), i * size + 1, F.lit(size + 1)))


def neighbours(piece: Column) -> Column:
    """array<struct<a,b>>: each character of a piece after its first, b, with the one before it, a."""
    chars = F.split(piece, "")
    return F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def believed(a: str, b: str) -> float:
    """The believed probability in identifiers of b after a: of its class, and of the character in it; a tenth of that all characters share alike."""
    of = {c: name for name, chars in CLASSES.items() for c in chars}
    chars = CLASSES[of[b]]
    own = LETTERS[b.lower()] / sum(LETTERS.values()) if b.isalpha() else 1 / len(chars)
    return STEPS[of.get(a, "start")][of[b]] * (0.9 * own + 0.1 / len(chars))


def ratios(rows: DataFrame, strength: float = 50.0) -> list[float]:
    """log(P(b | a) if random / P(b | a) if an identifier) at 128 * code(a) + code(b), for random strings like the samples and, 128 * 128
    places on, for uniform ones; a fixed number of entries.

    A character's steps weigh as much as `strength` steps of the belief they back off to: STEPS for identifiers, all alike for random strings.
    """
    counts = {(r.label, r.a, r.b): r.n for r in pair_counts(rows).collect()}
    k, out = len(ALPHABET), [0.0] * (2 * 128 * 128)
    for a in ["\n", *ALPHABET]:
        total = [sum(counts.get((label, a, b), 0) for b in ALPHABET) for label in (0, 1)]
        for b in ALPHABET:
            belief = believed(a, b), 1 / k
            p = [(counts.get((label, a, b), 0) + strength * belief[label]) / (total[label] + strength) for label in (0, 1)]
            at = 128 * ord(a) + ord(b)
            out[at], out[128 * 128 + at] = math.log(p[1]) - math.log(p[0]), -math.log(k) - math.log(p[0])
    return out


def log_ratio(value: Column, model: Column) -> Column:
    """The value's log-likelihood ratio under an array column of ratios(): the better of the two kinds of random strings, which are
    alike likely."""
    add = lambda acc, x, y: F.struct((acc["like"] + x).alias("like"), (acc["any"] + y).alias("any"))
    none = F.struct(F.lit(0.0).alias("like"), F.lit(0.0).alias("any"))

    def pair(acc: Column, p: Column) -> Column:
        at = F.ascii(p["a"]) * 128 + F.ascii(p["b"])
        return add(acc, F.coalesce(F.get(model, at), F.lit(0.0)), F.coalesce(F.get(model, at + 128 * 128), F.lit(0.0)))

    def piece(acc: Column, v: Column) -> Column:
        return F.aggregate(neighbours(v), acc, pair)

    return F.aggregate(chunks_of(value), none, piece, lambda acc: F.greatest(acc["like"], acc["any"]) - math.log(2))


def random_runs(model: Column, least_ratio: float) -> Column:
    """The runs of column `runs` that look random."""
    found = F.filter("runs", lambda r: log_ratio(r["value"], model) >= least_ratio * F.length(r["value"]) + math.log(LEAST_ODDS))
    return F.when(F.size("runs") > 0, found).otherwise(F.col("runs"))


def train(docs: DataFrame, text_col: str = "text") -> list[float]:
    """The table of ratios that the labelled samples of docs give."""
    return ratios(scanned(docs, text_col, [docs.columns[0]]))


def _found(docs: DataFrame, text_col: str, least_ratio: float, keep: list[str], model: list[float] | None = None) -> DataFrame:
    """(kept, base, spans)"""
    rows = scanned(docs, text_col, keep)
    # One literal text that folds into an array literal.
    table = F.split(F.lit(",".join(map(repr, ratios(rows) if model is None else model))), ",").cast("array<double>")
    return rows.select("kept", "base", F.array_sort(F.concat("base", random_runs(table, least_ratio))).alias("spans"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_ratio: float = LEAST_RATIO, model: list[float] | None = None) -> DataFrame:
    """(id, base, spans): base spans, and those with the method's spans, as arrays in (start, kind) order.

    A run is added when its ratio is at least `least_ratio` a character and LEAST_ODDS, under a model of train() or, without one, under that of docs.
    """
    return _found(docs, text_col, least_ratio, [id_col], model).select(F.col("kept")[id_col].alias(id_col), "base", "spans")


def without_secrets(docs: DataFrame, text_col: str = "text", least_ratio: float = LEAST_RATIO) -> DataFrame:
    """The rows of docs with every secret in the text replaced by a mark; all other columns stay as they are."""
    found = _found(docs, text_col, least_ratio, docs.columns)
    text = F.col("kept")[text_col]
    return found.select(*[(redacted(text, F.col("spans")) if c == text_col else F.col("kept")[c]).alias(c) for c in docs.columns])


def of_kind(spans: str, kind: int) -> Column:
    """How many spans are of a kind.  The lambda takes the span alone: Spark gives a second argument, even one with a default, the place."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]", size: int = 1 << 16) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark; a text without spans as it is.

    The text is cut into blocks first, so that no piece is looked for from the start of a long text.
    """

    def replaced(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            """The characters from a to b, end exclusive."""
            of = F.sequence(F.floor(a / size).cast("int"), F.floor((b - 1) / size).cast("int"))
            part = lambda i: F.substring(F.get(blocks, i), F.greatest(a - i * size, F.lit(0)) + 1, F.least(b - i * size, F.lit(size)) - F.greatest(a - i * size, F.lit(0)))
            return F.when(b > a, F.array_join(F.transform(of, part), "")).otherwise(F.lit(""))

        out = lambda at, s: F.when(s["start"] < at, F.lit("")).otherwise(F.concat(piece(at, s["start"]), F.lit(mark)))
        pieces = running(spans, F.lit(0), lambda at, s: F.greatest(at, s["stop"]), out, "string")
        last = F.array_max(F.transform(spans, lambda s: s["stop"]))
        return F.concat(F.array_join(pieces, ""), piece(last, F.length(text)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(F.size(spans) > 0, let(blocks, replaced)).otherwise(text)


def op5_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[of_kind("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
