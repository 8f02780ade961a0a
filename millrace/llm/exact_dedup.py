"""Exact dedup against a history: a minimal perfect hash over the historical distinct digests.

Texts are equal when their normalised forms (all characters of `[\\x20\\x09-\\x0D]` deleted) are. Rows are first
pre-aggregated by digest on the map side, so a group of any size reaches its shard as one record per task. Each shard
of the digest space builds a minimal perfect hash over its historical digests: slots hold the full 32-byte digest and
the winner's locator. A digest of the new rows hashes to one slot and is compared byte by byte: members are repeats
of the slot's text, nonmembers group separately by their digest. Winners then go back to the rows in a join by digest,
which Spark can split where one digest is hot.

Defined cases: null text is empty; the winner has the most code points, then the smallest doc_id (null last);
rows that repeat a winner's doc_id and length are told apart by number, and the first stays; very long texts are hashed
where they are, whole; an empty table gives no rows; extra columns, whatever their names, are ignored by the decisions
and kept by `keep_unique`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, documents, keep, mix, partitions


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def past(doc_id: Column) -> Column:
    """Whether a row belongs to the history: the MD5 of its id begins with 0 to 7."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))) < "8"


class PerfectHash:
    """Minimal perfect hash of distinct 16+ byte digests by displacement: keys fall into small buckets, and each
    bucket, largest first, takes the first seed that puts its keys on free slots. A table of n slots holds n keys."""

    def __init__(self, digests: np.ndarray):
        """digests: (n, 2) uint64, distinct rows."""
        self.n = n = len(digests)
        self.seeds = np.zeros(max(1, n // 4 + 1), np.uint32)
        if not n:
            return
        bucket = (digests[:, 0] % np.uint64(len(self.seeds))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(len(self.seeds) + 1))
        free = np.ones(n, bool)
        for b in np.argsort(-np.diff(bounds), kind="stable"):
            own = digests[order[bounds[b] : bounds[b + 1]]]
            if not len(own):
                break
            seed, step = 0, 16
            while True:  # seeds are tried a few at a time; more when few slots are free
                tried = np.arange(seed, seed + step, dtype=np.uint64)
                slots = self._slot(own[None, :, :], tried[:, None])
                ok = free[slots].all(axis=1)
                if len(own) > 1:
                    ok &= (np.diff(np.sort(slots, axis=1), axis=1) != 0).all(axis=1)
                if ok.any():
                    hit = int(ok.argmax())
                    self.seeds[b] = seed + hit
                    free[slots[hit]] = False
                    break
                seed, step = seed + step, min(4096, step * 2)

    def _slot(self, digests: np.ndarray, seed: np.ndarray) -> np.ndarray:
        return (mix(digests[..., 1] ^ mix(digests[..., 0] + seed * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.n)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; one outside the key set gets some slot."""
        if not self.n:
            return np.zeros(len(digests), np.int64)
        return self._slot(digests, self.seeds[(digests[:, 0] % np.uint64(len(self.seeds))).astype(np.int64)].astype(np.uint64))


#: Digests in a shard, about, at most.
SHARD = 200_000
_GROUP = "digest binary, keep_len int, keep_id long, rows long, keep_rows long, repeats boolean"


def groups(candidates: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest of candidates (digest binary, n_chars int, doc_id long, rows long, old boolean):
    digest, the winner's keep_len and keep_id, rows in all, rows that equal the winner in id and length, and repeats:
    whether the digest is in the history (old rows)."""
    order = F.struct(F.col("n_chars"), F.col("doc_id").isNotNull(), -F.col("doc_id"))
    partial = candidates.groupBy("digest", "old").agg(F.max(F.struct(order.alias("o"), F.col("doc_id"), F.col("n_chars"), F.col("rows"))).alias("w"), F.sum("rows").alias("rows"))
    shard = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")
    flat = partial.select(shard.alias("shard"), "digest", "old", F.col("w.doc_id").alias("doc_id"), F.col("w.n_chars").alias("n_chars"), F.col("w.rows").alias("same"), "rows")

    def resolve(key: tuple, table: pa.Table) -> pa.Table:
        digest, old = table.column("digest").to_pylist(), np.array(table.column("old").to_pylist(), bool)
        row = list(zip(table.column("n_chars").to_pylist(), table.column("doc_id").to_pylist(), table.column("same").to_pylist(), table.column("rows").to_pylist(), strict=True))
        numbers = np.array([struct.unpack_from("<QQ", d, 8) for d in digest], np.uint64).reshape(-1, 2)
        history = np.flatnonzero(old)
        hashed = PerfectHash(numbers[history])
        slots: list = [None] * hashed.n  # full digest, winner, rows
        for i, s in zip(history, hashed.slots(numbers[history]), strict=True):
            slots[s] = [digest[i], row[i][:3], row[i][3], True]
        apart = {}
        fresh = np.flatnonzero(~old)
        rank = lambda w: (w[0], w[1] is not None, -(w[1] or 0))
        for i, s in zip(fresh, hashed.slots(numbers[fresh]), strict=True):
            at = slots[s] if hashed.n and slots[s][0] == digest[i] else apart.setdefault(digest[i], [digest[i], row[i][:3], 0, False])
            at[2] += row[i][3]
            if rank(row[i]) > rank(at[1]):
                at[1] = row[i][:3]
            elif at[3] and rank(row[i]) == rank(at[1]):
                at[1] = (*at[1][:2], at[1][2] + row[i][2])
        out = [*slots, *apart.values()]
        return pa.table({"digest": pa.array([x[0] for x in out], pa.binary()), "keep_len": pa.array([x[1][0] for x in out], pa.int32()), "keep_id": pa.array([x[1][1] for x in out], pa.int64()), "rows": pa.array([x[2] for x in out], pa.int64()), "keep_rows": pa.array([x[1][2] for x in out], pa.int64()), "repeats": pa.array([x[3] for x in out], pa.bool_())})

    return flat.groupBy("shard").applyInArrow(resolve, _GROUP)


def resolve(docs: DataFrame, old: Column) -> DataFrame:
    """digest, doc_id, n_chars, rows (that agree in these), and the columns of groups(); old: marks history rows."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.unhex(F.sha2(normal(F.col("text")), 256)).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n_chars"), old.alias("old"))
    rows = keep(rows.groupBy("digest", "doc_id", "n_chars", "old").agg(F.count("*").alias("rows")), "digests")
    shards = max(2 * partitions(spark), -(-rows.count() // SHARD))  # so that a shard's memory doesn't grow with the data
    found = groups(rows, shards).withColumnRenamed("rows", "group_size")
    return rows.join(found, "digest")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the history is about half of them, by a hash of the id, the new rows are the other half. Groups and
    winners are over both."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = resolve(docs, past(F.col("doc_id")))
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_len"))
    out = found.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select("doc_id", "keep_id", F.col("group_size"), (best & (F.col("number") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("repeats").alias("in_history"))


def keep_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of equal texts the winner stays, with all its columns."""
    found = resolve(docs.select("doc_id", "text"), past(F.col("doc_id")))
    best = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_len")))
    names = docs.columns
    text = F.col("text")
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.unhex(F.sha2(normal(text), 256)).alias("_digest"), F.col("doc_id").cast("long").alias("_id"), F.length(F.coalesce(text, F.lit(""))).alias("_len"))
    chosen = best.select(F.col("digest").alias("_own"), F.col("doc_id").alias("_own_id"), F.col("n_chars").alias("_own_len"), "rows")
    met = keyed.join(chosen, (keyed._digest == chosen._own) & keyed._id.eqNullSafe(chosen._own_id) & (keyed._len == chosen._own_len))
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    again = met.where("rows > 1").dropDuplicates(["_id", "_own"])  # repeated rows: nearly always none
    return met.where("rows = 1").select(*back).union(again.select(*back))
