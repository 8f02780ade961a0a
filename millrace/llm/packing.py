"""Packing along a space-filling curve.

A document's vector of hashed byte 4-grams is projected to a few dimensions, the point's Hilbert key ranks it, and
documents are dealt to ranges of the curve and sorted by that key (ties by a hash of the text, then doc_id). A point's
coordinates are ranks among a sample of SAMPLE documents (of least hashes), so that points fill the cube.

Ranges are even in bytes: the bytes of each of 2^CELL_BITS cells of the curve are summed up first, and those of a cell of
more than a range's share again by STEP_BITS more of the key, until no cell is too large or the key ends. The driver cuts
the sequence of cells into ranges. So every range is an interval of the curve, however many there are; only documents of
one key that are more than a range (a large group of copies) are dealt to several by a hash of text and id. Each range is
packed by itself: its documents' ids follow one another along the curve, sequences of 1024 are cut from them, and what is
left at the end of a range makes sequences of powers of two, which need no padding.

Defined cases: null or empty text is its end id alone; a very long text spans sequences and is tokenised whole, by one
task; repeated rows and rows with a null doc_id are packed each; an empty table gives no rows; extra columns are left
alone, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, keep, partitions, sliced, utf8

#: Texts whose characters are all below this are tokenised by the faster library, which has the same vocabulary and
#: gives the same ids there (tests compare the two over every such character); all others by `tokenizers`.
PLAIN = 0x250
#: Dimensions and bits of a point, bits of the cells whose bytes are summed up first, and by how many a large one is cut.
DIMENSIONS, POINT_BITS, CELL_BITS, STEP_BITS = 4, 12, 14, 6
KEY_BITS = DIMENSIONS * POINT_BITS
#: Documents whose coordinates scale the cube, and steps of that scale.
SAMPLE, STEPS = 4096, 512
#: Bytes of texts that become Python strings at once.
SLICE = 1 << 20
#: Bytes that a document counts for beside its text.
ROW = 64


class Ids:
    """The ids of a text by the byte-level BPE vocabulary `name`, as uint32."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        self.name = name
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        import regex

        self.other = regex.compile(rf"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u{PLAIN - 1:04x}]|<\|")

    @cached_property
    def slow(self):
        """Loaded with the first text that needs it."""
        import public_tokenizers
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))

    def __call__(self, text: str) -> np.ndarray:
        if self.other.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@cache
def ids_by(name: str = "byte_bpe_50k") -> Ids:
    """One of a worker's, for all its tasks."""
    return Ids(name)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys (uint64) of points (n, dims) of uint64 below 2 ** bits; dims * bits is at most 63.

    Undoes the curve's reflections bit plane by bit plane from the top, then reads the Gray code off the planes."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for plane in range(bits - 1, 0, -1):
        q = one << np.uint64(plane)
        low = q - one
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        q = one << np.uint64(plane)
        flip = np.where(x[-1] & q, flip ^ (q - one), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << one) | ((x[d] >> np.uint64(plane)) & one)
    return key


def spread(column: pa.Array, dims: int = DIMENSIONS, buckets: int = 256) -> np.ndarray:
    """The point (float32) of each text: 4-gram counts in hashed buckets, made unit vectors, projected by a fixed random
    matrix of signs."""
    data, at = utf8(column)
    signs = np.random.default_rng(7).choice([-1.0, 1.0], (buckets, dims))
    points = np.zeros((len(at) - 1, dims), np.float32)
    for i in range(len(at) - 1):
        raw = data[at[i] : at[i + 1]]
        counts = np.zeros(buckets)
        for a in range(0, max(0, len(raw) - 3), 1 << 20):
            x = raw[a : a + (1 << 20) + 3].astype(np.uint32)
            if len(x) > 3:
                h = (x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24) * np.uint32(0x9E3779B1)
                counts += np.bincount(h >> np.uint32(24), minlength=256)[:buckets]
        norm = np.sqrt(counts @ counts) or 1.0
        points[i] = (counts @ signs) / norm
    return points


def scale_of(sample: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Quantiles (steps x dims) of a sample of points."""
    return np.quantile(sample, np.linspace(0, 1, steps), axis=0) if len(sample) else np.zeros((steps, DIMENSIONS))


def curve_keys(points: np.ndarray, scale: np.ndarray, bits: int = POINT_BITS) -> np.ndarray:
    """The Hilbert key of each point, its coordinates being ranks on the scale in 2 ** bits steps."""
    rank = np.linspace(0, 1, len(scale))
    place = np.stack([np.interp(points[:, d], scale[:, d], rank) for d in range(points.shape[1])], axis=1)
    return hilbert(np.clip(place * (1 << bits), 0, (1 << bits) - 1).astype(np.uint64), bits).astype(np.int64)


def cells_of(keys: DataFrame, ranges: int) -> dict[int, int]:
    """The bytes of each cell of the curve by the cell's first key, of keys (curve_key, size). Cells of more than a
    range's share are cut again and again: there are at most `ranges` of them at a time, and 2 ** STEP_BITS cells of each."""
    told = lambda rows, bits: {r["cell"] << (KEY_BITS - bits): r["size"] for r in rows.groupBy(F.shiftright("curve_key", KEY_BITS - bits).alias("cell")).agg(F.sum("size").alias("size")).collect()}
    bits, cells = CELL_BITS, told(keys, CELL_BITS)
    share = -(-sum(cells.values()) // max(1, ranges))
    large = [k for k, size in cells.items() if size > share]
    while large and bits < KEY_BITS:
        inside = keys.sparkSession.createDataFrame([(k >> (KEY_BITS - bits),) for k in large], "at_cell long")
        rows = keys.join(F.broadcast(inside), F.shiftright("curve_key", KEY_BITS - bits) == F.col("at_cell"))  # at most `ranges` rows
        bits = min(KEY_BITS, bits + STEP_BITS)
        parts = told(rows, bits)
        for k in large:
            del cells[k]
        cells |= parts
        large = [k for k, size in parts.items() if size > share]
    return cells


def cut_ranges(sizes: dict[int, int], ranges: int) -> list[tuple[int, int, int]]:
    """(cell, first range, ranges): cells in order, dealt so that a range has about its share of all bytes; a cell of more
    than a share goes to several ranges, which it has for itself."""
    share = max(1, -(-sum(sizes.values()) // max(1, ranges)))
    out, at, used = [], 0, 0
    for cell, size in sorted(sizes.items()):
        if used and used + size > share:
            at, used = at + 1, 0
        n = -(-size // share)
        out.append((cell, at, n))
        at, used = (at + n, 0) if n > 1 else (at, used + size)
    return out


def pack(docs: DataFrame, length: int = 1024, end: int = 0, ranges: int | None = None) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    curve_key. length: a power of two."""
    spark = docs.sparkSession

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = spread(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("mixed"), batch.column("size"), *(pa.array(points[:, d]) for d in range(DIMENSIONS))], names=["mixed", "size", *axes])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([batch.column(a).to_numpy() for a in axes], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(points, scale)), batch.column("size")], names=["curve_key", "size"])

    @F.arrow_udf("curve_key long, range int")
    def deal(text: pa.Array, mixed: pa.Array) -> pa.Array:
        starts, first, n = places.value
        keys = curve_keys(spread(text), scale)
        at = np.maximum(np.searchsorted(starts, keys, "right") - 1, 0)
        turn = mixed.to_numpy().view(np.uint64) % n[at].astype(np.uint64)
        return pa.StructArray.from_arrays([pa.array(keys), pa.array(first[at] + turn.astype(np.int64), pa.int32())], names=["curve_key", "range"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ids_by()
        base = TaskContext.get().partitionId() << 40
        sequence, used = 0, 0
        tail: list[tuple] = []  # pieces of the sequence that isn't full yet, with their ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"]
        schema = pa.schema([(n, pa.int64()) for n in names])
        for batch in sliced(batches, 1, SLICE):
            out: list[tuple] = []  # pieces of a slice
            for doc_id, text, curve in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "curve_key")), strict=True):
                ids = np.append(ids_of(text or ""), np.uint32(end)).astype("<u4")
                start = 0
                while start < len(ids):
                    n = min(len(ids) - start, length - used)
                    piece = ids[start : start + n]
                    tail.append((doc_id, start, piece, len(ids), used, curve))
                    start, used = start + n, used + n
                    if used == length:
                        out += [(d, s, len(p), zlib.crc32(p.tobytes()), t, base + sequence, o, c) for d, s, p, t, o, c in tail]
                        tail, used, sequence = [], 0, sequence + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * len(names))], schema=schema)
        out = []
        while tail:  # what is left: sequences of powers of two
            size = 1 << (used.bit_length() - 1)
            room, rest = size, []
            for d, s, p, t, _, c in tail:
                own = p[:room]
                if len(own):
                    out.append((d, s, len(own), zlib.crc32(own.tobytes()), t, base + sequence, size - room, c))
                    room -= len(own)
                if len(own) < len(p):
                    rest.append((d, s + len(own), p[len(own) :], t, 0, c))
            tail, used, sequence = rest, used - size, sequence + 1
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * len(names))], schema=schema)

    axes = [f"p{d}" for d in range(DIMENSIONS)]
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text", "doc_id").alias("mixed"), bytes_.alias("size"))
    points = keep(rows.select("text", "mixed", "size").mapInArrow(measure, "mixed long, size long, " + ", ".join(f"{a} float" for a in axes)), "points")
    sample = points.orderBy("mixed", *axes).limit(SAMPLE).select(*axes).collect()
    scale = scale_of(np.array([tuple(r) for r in sample], np.float32).reshape(-1, DIMENSIONS))
    ranges = ranges or partitions(spark)
    table = cut_ranges(cells_of(points.mapInArrow(rank, "curve_key long, size long"), ranges), ranges)
    count = max((first + n for _, first, n in table), default=1)
    runs = [t for i, t in enumerate(table) if not i or t[1:] != table[i - 1][1:]] or [(0, 0, 1)]  # cells of one range are one interval
    places = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)))
    told = deal("text", "mixed")  # texts stay in the JVM; both mentions are computed at once
    dealt = rows.select("doc_id", "text", told["curve_key"].alias("curve_key"), told["range"].alias("range"))
    sorted_ = dealt.repartitionById(count, "range").sortWithinPartitions("curve_key", F.xxhash64("text"), "doc_id").select("doc_id", "text", "curve_key")
    return sorted_.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of the packed sequences."""
    return pack(docs)
