"""Helpers shared by the training-data operators.

Every operator selects the columns it names and ignores all others, so extra columns (whatever they are
called) never clash with what it adds.  A null text counts as the empty text unless an operator says otherwise.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellscape.operators.ranks import prefix_sums  # noqa: F401  the operators take it from here
from cellscape.sources.scratch import stored  # noqa: F401

#: Bytes of one Arrow batch between the JVM and a Python worker; rows longer than this travel alone.
BATCH_BYTES = 4 << 20


def _bytes(size: str) -> int:
    """A size as Spark settings have it (67108864b, 64m, -1)."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema) with Arrow batches of bounded bytes: lowers the session's limit to BATCH_BYTES, and gives memory back after each task."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(conf.get(name)) <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Give back what a task's batches held: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or with underscores before it so that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(name: str) -> Column:
    """An id as text, a null id as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(name: str, n: int) -> Column:
    """crc32 of the id as text, mod n."""
    return F.crc32(id_text(name)) % F.lit(n)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as b""."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has about `most` bytes of text, one row at least: bounds what a worker holds."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


class WordHash(dict):
    """xxh64 of words, remembered; emptied when it has grown to `most` words."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixing of uint64 values (murmur3's finaliser, after adding a seed)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Members:
    """A Bloom filter over 64-bit keys with a fixed number of bits: what it lets through holds all members, and some others."""

    SEGMENTS = 64

    def __init__(self, data: bytes, bits: int):
        self.data, self.segment = np.frombuffer(data, np.uint8), bits // self.SEGMENTS

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for seed in (1, 2, 3):
            at = (keys >> np.uint64(58)) * np.uint64(self.segment) + mixed(keys, seed) % np.uint64(self.segment)
            out &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    @classmethod
    def of(cls, keys: DataFrame, most_bits: int = 1 << 26) -> "Members":
        """The filter of a one-column table of long keys, 16 bits a key and `most_bits` at most; it reaches the driver in segments.

        Beyond most_bits / 16 keys it lets more through, which costs time and never a member.
        """
        n = keys.count()
        bits = 1 << 16
        while bits < min(16 * n, most_bits):
            bits *= 2
        segment = bits // cls.SEGMENTS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                k = b.column(0).to_numpy().view(np.uint64)
                of = (k >> np.uint64(58)).astype(np.int64)
                for s in np.unique(of):
                    data = held.setdefault(int(s), np.zeros(segment // 8, np.uint8))
                    for seed in (1, 2, 3):
                        at = mixed(k[of == s], seed) % np.uint64(segment)
                        np.bitwise_or.at(data, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["s", "data"])

        name = keys.columns[0]
        data = np.zeros(bits // 8, np.uint8)
        for s, part in in_arrow(keys.repartition(cls.SEGMENTS, F.shiftrightunsigned(F.col(name), 58)), run, "s int, data binary").collect():
            data[s * segment // 8 : (s + 1) * segment // 8] |= np.frombuffer(part, np.uint8)
        return cls(data.tobytes(), bits)


def may_be_in(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of long columns against a broadcast filter over the one-column table `keys`: true for all its keys and for some others."""
    shared = keys.sparkSession.sparkContext.broadcast(Members.of(keys))

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        return pa.array(shared.value.may_hold(h.to_numpy().view(np.uint64)), pa.bool_())

    return test


def id_hash(name: str) -> Column:
    """A 64-bit hash of an id as text; a null id and an empty one have the same."""
    return F.xxhash64(id_text(name))
