"""Vector code compression: product codes with integer codebooks, entries filtered by segment-mean lower bounds.

Vectors become integers and are cut into parts; each part position has a codebook, trained by rounds of assignment and
integer averages. An assignment works from coarse to fine: over 1, 2 and 4 segments of a part, the segments' means and
the norms of what is left of them bound every distance from below,

    |x - c|^2 >= sum over segments of length * (mean x - mean c)^2 + (residual x - residual c)^2,

and an entry goes once its bound is beyond the exact distance of the entry that looked nearest. Bounds are in floating
point and lowered by more than its error, so no nearest entry is ever lost; the survivors get exact integer distances.

The codebooks (parts x entries x positions) are all that reaches the driver: each round is one pass over the vectors,
whose sums and counts by part, entry and position are added up in each task and then by Spark.

Defined cases: vectors that are null or hold null or non-finite components are dropped; so are those whose length isn't
that of the kept vector with the smallest id, as no codebook fits them; a length that the parts don't divide is cut as
evenly as can be; components beyond 2 ** 15 count as 2 ** 15, as the errors of larger ones don't fit in a long;
with fewer kept vectors than entries the codebooks have as many entries as vectors; equal or null ids are told
apart by their vectors (null ids last) and all rows are returned; sums of errors beyond a long are the greatest long; an
empty table gives no rows; extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import keep

#: Rows that the numpy passes take at once.
ROWS = 4096
#: Integer components lie within this, so that the squared distances of 64 of them fit in a long.
MOST = 1 << 27
#: What the bounds are lowered by, times the squared norms: far more than rounding makes of them.
SLACK = 4e-6
LONG = (1 << 63) - 1

Books = list[np.ndarray]


def integers(column: pa.Array, scale: int, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the whole vectors of a list column: rows that aren't null, have no null or non-finite component
    and, where it is given, have that length; without it the rows' common length is theirs to have."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.array(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)
    ends = np.cumsum(np.maximum(size, 0))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    ok = (size >= 0) & (bad[ends] == bad[ends - np.maximum(size, 0)])
    if length is not None:
        ok &= size == length
    at = np.flatnonzero(ok)
    if not len(at):
        return at, np.zeros((0, length or 0), np.int64)
    x = values[(ends - np.maximum(size, 0))[at][:, None] + np.arange(int(size[at[0]]))]
    return at, np.clip(np.floor(x * scale), -MOST, MOST).astype(np.int64)


def cuts(length: int, parts: int) -> list[int]:
    return [length * i // parts for i in range(parts + 1)]


def _segments(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment: its length, the vectors' sums, and the norms of what is left without the means."""
    at = np.unique(np.array(cuts(x.shape[1], count)[:-1]))
    long = np.diff(np.append(at, x.shape[1])).astype(np.float64)
    total = np.add.reduceat(x, at, axis=1).astype(np.float64)
    squares = np.add.reduceat(x * x, at, axis=1).astype(np.float64)
    return long, total, np.sqrt(np.maximum(squares - total * total / long, 0))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row (ties to the lower index), its exact squared distance, and how many exact distances
    were worked out for that."""
    n, width = x.shape
    if not n or not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    rows, entries, bound, worked = np.zeros(0, np.int64), np.zeros(0, np.int64), None, n
    slack = SLACK * ((x * x).sum(axis=1).astype(np.float64)[:, None] + (book * book).sum(axis=1).astype(np.float64)) + 1
    for count in (1, 2, 4):
        if count > width:
            break
        long, sx, rx = _segments(x, count)
        _, sc, rc = _segments(book, count)
        if bound is None:
            low = ((sx[:, None] - sc) ** 2 / long + (rx[:, None] - rc) ** 2).sum(axis=2) - slack
            first = low.argmin(axis=1)
            bound = ((x - book[first]) ** 2).sum(axis=1)
            rows, entries = np.nonzero(low <= bound[:, None])
        else:
            low = ((sx[rows] - sc[entries]) ** 2 / long + (rx[rows] - rc[entries]) ** 2).sum(axis=1) - slack[rows, entries]
            left = low <= bound[rows]
            rows, entries = rows[left], entries[left]
    exact = ((x[rows] - book[entries]) ** 2).sum(axis=1)
    start = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))  # each row keeps one entry at least
    least = np.minimum.reduceat(exact, start)
    hit = np.flatnonzero(exact == np.repeat(least, np.diff(np.append(start, len(rows)))))
    best = hit[np.unique(rows[hit], return_index=True)[1]]
    return entries[best], least, worked + len(rows)


def _assigned(x: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (rows x parts) and errors (rows x parts)."""
    at = cuts(x.shape[1], len(books))
    got = [nearest(x[:, at[p] : at[p + 1]], book)[:2] for p, book in enumerate(books)]
    return np.stack([i for i, _ in got], axis=1), np.stack([e for _, e in got], axis=1)


def _start(rows: DataFrame, parts: int, entries: int, scale: int) -> Books:
    """The parts of the kept vectors with the smallest ids. rows: id, v."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for length in np.unique(size[size >= 0]):
                at, x = integers(batch.column(1), scale, int(length))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(list(x), pa.list_(pa.int64()))], names=["id", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    first = rows.mapInArrow(whole, f"id {kind}, x array<bigint>").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return []
    x = np.array([r.x for r in first if len(r.x) == len(first[0].x)], np.int64).reshape(-1, len(first[0].x))
    at = cuts(x.shape[1], parts)
    return [x[:, at[p] : at[p + 1]].copy() for p in range(parts)]


def train(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Books:
    """One codebook (entries x positions) for each part of the vectors of rows (id, v); none without kept vectors."""
    books = _start(rows, parts, entries, scale)
    if not books:
        return books
    length = sum(b.shape[1] for b in books)
    for _ in range(rounds):

        def add(batches: Iterator[pa.RecordBatch], books: Books = books) -> Iterator[pa.RecordBatch]:
            sums, seen = [np.zeros_like(b) for b in books], np.zeros((len(books), len(books[0])), np.int64)
            at = cuts(length, len(books))
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    _, x = integers(batch.column(0).slice(lo, ROWS), scale, length)
                    index, _ = _assigned(x, books)
                    for p, total in enumerate(sums):
                        np.add.at(total, index[:, p], x[:, at[p] : at[p + 1]])
                        seen[p] += np.bincount(index[:, p], minlength=len(total))
            told = [(p, k, i, int(t), int(seen[p, k])) for p, total in enumerate(sums) for k in np.flatnonzero(seen[p]).tolist() for i, t in enumerate(total[k])]
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "at", "total", "n"), x, strict=True)) for x in told], schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("total", pa.int64()), ("n", pa.int64())]))

        by_task = rows.select("v").mapInArrow(add, "part int, entry int, at int, total long, n long")
        books = [b.copy() for b in books]
        for r in by_task.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # parts x entries x positions
            books[r.part][r.entry, r["at"]] = r.total // r.n
    return books


def encode(rows: DataFrame, books: Books, scale: int = 4096) -> DataFrame:
    """The kept rows with code string (two hexadecimal digits a part) and error long; rows: v and any columns."""
    others = [c for c in rows.columns if c != "v"]
    if not books:
        return rows.where("false").select(*others, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    length = sum(b.shape[1] for b in books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                at, x = integers(batch.column("v"), scale, length)
                index, error = _assigned(x, books)
                told = [bytes(r).hex() for r in index.astype(np.uint8)]
                own = [batch.column(c).take(pa.array(at)) for c in others]
                yield pa.RecordBatch.from_arrays([*own, pa.array(told, pa.string()), pa.array(error.sum(axis=1), pa.int64())], names=[*others, "code", "error"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others), "code string", "error long"])
    return rows.mapInArrow(code, schema)


def digest(books: Books) -> str:
    return sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").alias("v"))
    books = train(rows.select("id", "v"))
    coded = keep(encode(rows, books), "codes")
    summed = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")), F.lit(LONG)).cast("long").alias("label_error"))
    kin = summed.withColumnRenamed("label", "kin")
    out = coded.join(kin, F.col("label").eqNullSafe(F.col("kin")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
