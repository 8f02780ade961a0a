"""Shared pieces of the training-data operators: scratch tables, word hashing in numpy, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import keep, new_path  # noqa: F401  (taken from here by the operators)

#: The white space of all contracts here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that the numpy passes take at once; a longer document is cut at white space.
PIECE = 1 << 20

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by (null id: as the empty text); the rule that holds rows out of training."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (n + 1); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of that string column, so that what is made of one stays small."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse's powers, modulo 2 ** 64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers.append(np.multiply.accumulate(run))
    return _powers[0], _powers[1]


def _pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of documents of about PIECE bytes: (first document, end document, byte bounds). One that is longer comes alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        yield i, j, at[i : j + 1]
        i = j


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = _LOWER[raw]
    inside = _WORD[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(raw)]] = False
    first = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = at[1:][at[1:] > 0] - 1
    after[ends] = False
    last = np.flatnonzero(inside & ~after) + 1
    power, inverse = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    hashed = mix((total[last] - total[first]) * inverse[first])
    return hashed, first, last


def words(column: pa.Array, spans: bool = False):
    """64-bit hashes of the lower-cased (A-Z) words of each text, and the offsets (n + 1) of each text's words.
    With spans also each word's first byte and end in the column's buffer."""
    data, at = utf8(column)
    got, count, begins, ends = [], [np.zeros(1, np.int64)], [], []
    for i, j, bound in _pieces(data, at):
        lo, hi = int(bound[0]), int(bound[-1])
        if hi - lo <= 2 * PIECE:
            parts = [(lo, hi)]
        else:  # one long document: cut at white space, so that memory stays bounded
            parts, a = [], lo
            while a < hi:
                b = min(hi, a + PIECE)
                while b < hi and _WORD[data[b]]:
                    gap = np.flatnonzero(~_WORD[data[b : b + PIECE]])
                    b = b + int(gap[0]) if len(gap) else min(hi, b + PIECE)
                parts.append((a, b))
                a = b
        n = np.zeros(j - i, np.int64)
        for a, b in parts:
            own = bound - lo if (a, b) == (lo, hi) else np.array([0, b - a])
            h, first, last = _words(data[a:b], own)
            got.append(h)
            if spans:
                begins.append(first + a)
                ends.append(last + a)
            n += np.diff(np.searchsorted(first, own)) if len(parts) == 1 else len(h)
        count.append(n)
    off = np.cumsum(np.concatenate(count))
    hashed = np.concatenate(got) if got else np.zeros(0, np.uint64)
    if not spans:
        return hashed, off
    none = np.zeros(0, np.int64)
    return hashed, off, np.concatenate(begins) if begins else none, np.concatenate(ends) if ends else none


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of longs: (node, component), component the smallest node reached.

    Alternates large-star and small-star steps, each a grouped minimum joined back (so a hot node is pre-aggregated,
    and the join can be split), and writes each round to the shared folder. Nodes without an edge aren't in the result.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = keep(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
