"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has CELLS cells; a shard owns the cells that end at one of its virtual nodes. A row's key falls into a cell by
hash. Shards hold a bounded number of rows: rows beyond a full shard's bound go on clockwise to the next virtual node
of a shard that has room. Only the counts of the cells (CELLS rows, whatever the data) reach the driver, which walks
the ring and returns, for each cell, which of its rows (by rank) go where and which slots they get there; the rows find
their place by a join with that table, whose size is bounded by the ring's.

The bound is exact here: all rows spread over the shards so that counts are at most one apart (law `rows`). Most rows
stay on their home shard, and a change of the number of shards moves those of the new shard and what overflows.

Defined cases: null text has no bytes (size 8, crc32 0); a null doc_id is a key like others; rows that repeat doc_id and
text share a cell, and are dealt out by rank; very long texts are only measured; an empty table gives no rows; extra
columns are left alone by the query, and kept by `shard`, which takes rows of any columns beside key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import documents, keep

CELLS = 1 << 14
_M = (1 << 64) - 1


def _mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


def ring(shards: int, virtual: int, cells: int = CELLS) -> list[int]:
    """The home shard of each cell: the owner of the first virtual node at or after it, clockwise. A cell has at most
    one virtual node: on a taken cell it goes to the one that its next hash names. A shard's nodes depend on its number."""
    owner: dict[int, int] = {}
    for s in range(shards):
        for v in range(virtual):
            h = _mixed(s * 1_000_003 + v)
            while h % cells in owner:
                h = _mixed(h)
            owner[h % cells] = s
    home, nearest = [0] * cells, owner[min(owner)]
    for c in range(cells - 1, -1, -1):
        nearest = owner.get(c, nearest)
        home[c] = nearest
    return home


def place(counts: dict[int, int], shards: int, virtual: int, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where the rows of each cell go, with exact bounds."""
    home = ring(shards, virtual, cells)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    ends = [c for c in range(cells) if home[c] != home[(c + 1) % cells]]  # the last cell of each run of one shard
    after = {c: i for i, c in enumerate(ends)}
    run_of, i = [0] * cells, 0
    for c in range(cells):
        run_of[c] = i % max(1, len(ends))
        i += c in after
    owner = [home[c] for c in ends] or [home[0]]
    out = []
    pending = [(run_of[c], c, 0, n) for c, n in sorted(counts.items()) if n]
    while pending:  # a lap moves what overflows by one run that has room
        on = []
        for run, cell, lo, hi in pending:
            s = owner[run]
            take = min(hi - lo, room[s])
            if take:
                out.append((cell, lo, lo + take, s, used[s]))
                room[s] -= take
                used[s] += take
            if lo + take < hi:
                nxt = (run + 1) % len(owner)
                while not room[owner[nxt]]:
                    nxt = (nxt + 1) % len(owner)
                on.append((nxt, cell, lo + take, hi))
        pending = on
    return out


def shard(rows: DataFrame, shards: int, virtual: int = 64) -> DataFrame:
    """rows with key long (a hash) and any columns but cell, rank, shard, slot, home_shard and those of the ring's table.
    Adds shard, slot (gapless from 0 in a shard) and home_shard. Rows are ranked in their cell by key and then by all
    other columns."""
    spark = rows.sparkSession
    celled = keep(rows.withColumn("cell", F.pmod("key", F.lit(CELLS)).cast("int")), "keys")
    counts = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}  # at most CELLS rows
    home = ring(shards, virtual)
    table = [(c, lo, hi, s, at, home[c]) for c, lo, hi, s, at in place(counts, shards, virtual)]
    places = spark.createDataFrame(table, "at_cell int, lo long, hi long, shard int, base long, home_shard int")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("key", *[c for c in rows.columns if c != "key"])) - 1
    met = celled.withColumn("rank", rank.cast("long")).join(F.broadcast(places), (F.col("cell") == F.col("at_cell")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return met.select(*rows.columns, "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), "home_shard")


def sized(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = docs.select(F.col("doc_id"), (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32"))
    return out.withColumn("key", F.xxhash64("doc_id", "text_crc32"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(sized(documents(spark, sf_dir)), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Writes docs under path/shard=N/, in the order of the slots. One task writes a part of a shard."""
    keyed = docs.withColumn("key", F.xxhash64("doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    shard(keyed, shards).drop("key", "home_shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
