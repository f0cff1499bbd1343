"""Operator 6, token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table from frequent pre-tokens to their number of tokens (at most `most_frequent` entries:
the tokenizer's own vocabulary first, then the commonest pre-tokens of a sample, bounded in texts and characters).
Tier two encodes the pre-tokens it lacks with the library and keeps their lengths in a bounded cache of the Python worker.
No pre-token is ever shuffled.  The sample only decides what is fast, never a count.

Cases: null and empty texts count 0 tokens; special strings inside a text count as the library's default handles them
(one token each); texts with characters whose Unicode class may differ between libraries go whole through the library, and so does a
pre-token of any length; long texts are counted whole; repeated rows, and texts of equal length (ties), are counted one by one; an empty
table gives an empty one.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.llm.common import in_arrow, slices, table, texts_of

#: The byte-level pre-tokenizer's pattern (a fixed value of that tokenizer family).
PRETOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters whose classes are the same in every Unicode version since 6: Latin, Greek, Cyrillic, punctuation, currency, kana, common Han.
SETTLED = regex.compile(r"[^\x00-\x7f -ͷЀ-ԯ‐-‧‰-⁞₠-₹ぁ-ゖァ-ヺ一-鿋]")

_worker: dict = {}


def library(path: str):
    """The tokenizer of a file, kept for the life of the process."""
    if _worker.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            specials = [t["content"] for t in json.load(f)["added_tokens"]]
        _worker.update(path=path, tokenizer=tokenizer, cache={}, special=regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None)
    return _worker["tokenizer"]


def lengths_of(path: str, pieces: list[str]) -> list[int]:
    return [len(e.ids) for e in library(path).encode_batch(pieces, add_special_tokens=False)]


class Lengths(dict):
    """Pre-token to number of tokens: the broadcast table, then the worker's cache, then the library."""

    def __init__(self, path: str, table: dict[str, int], most: int):
        super().__init__()
        self.path, self.table, self.most = path, table, most

    def __missing__(self, piece: str) -> int:
        n = self.table.get(piece)
        if n is None:
            if len(self) >= self.most:
                self.clear()
            n = self[piece] = lengths_of(self.path, [piece])[0]
        return n


def count_tokens_of(text: str, lengths: Lengths) -> int:
    tokenizer, special = library(lengths.path), _worker["special"]
    if not text.isascii() and SETTLED.search(text):
        return len(tokenizer.encode(text, add_special_tokens=False).ids)
    n, parts = 0, [text]
    if special is not None and special.search(text):
        n, parts = len(special.findall(text)), special.split(text)
    get, known = lengths.__getitem__, lengths.table.get
    for part in parts:
        pieces = PRETOKEN.findall(part)
        found = list(map(known, pieces))
        if None in found:
            n += sum(v if v is not None else get(p) for v, p in zip(found, pieces))
        else:
            n += sum(found)
    return n


def frequent_lengths(df: DataFrame, path: str, text_col: str, most_frequent: int, sample_rows: int, sample_chars: int = 4096) -> dict[str, int]:
    """At most `most_frequent` pre-tokens with their lengths, from the vocabulary and the first `sample_chars` characters of `sample_rows` texts."""
    tokenizer = library(path)
    pieces = []
    for token in tokenizer.get_vocab(with_added_tokens=False).values():
        piece = tokenizer.decode([token])
        if "\ufffd" not in piece and PRETOKEN.findall(piece) == [piece]:
            pieces.append(piece)
    pieces = sorted(pieces)[:most_frequent]
    have, room = set(pieces), most_frequent - len(pieces)

    # The first characters of a few texts: what reaches the driver has a bound, and only speed depends on it.
    sample = df.select(F.substring(text_col, 1, sample_chars).alias("t")).filter("t is not null").limit(sample_rows if room > 0 else 0)
    seen: Counter = Counter()
    for (text,) in sample.collect():
        seen.update(p for p in PRETOKEN.findall(text) if len(p) <= 64)
    pieces += [p for p, _ in seen.most_common() if p not in have and PRETOKEN.findall(p) == [p]][:room]
    return dict(zip(pieces, lengths_of(path, pieces)))


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, most_frequent: int = 100_000, sample_rows: int = 2_000, cache: int = 200_000) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(frequent_lengths(rows, path, "text", most_frequent, sample_rows))
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library(path)
        lengths = _worker.get("lengths")
        if lengths is None or lengths.table is not shared.value:
            lengths = _worker["lengths"] = Lengths(path, shared.value, cache)
        for b in slices(batches):
            raw = texts_of(b.column(1))
            n = [count_tokens_of(x.decode(), lengths) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return in_arrow(rows, run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return count_tokens(table(spark, sf_dir, "documents"), path)
