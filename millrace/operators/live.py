"""Calls that are made while a job runs: replies that persist across runs, and attempts until a reply passes.

State lies in folders on a file system that driver and executors share. A piece of work is written, and then a marker is
put down that commits it; what has no marker isn't read. So a run that was killed halfway goes on where it was: no call
whose piece was committed is made again, and a piece that wasn't is made again whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import calls
from millrace.operators.calls import made, with_cache
from millrace.sources.scratch import delete, folder_for, keep, kept_for

REPLIES = "key string, reply string"
LOG = "id {kind}, attempt long, reply string"
ANSWERS = "id {kind}, text string, attempt long, reply string"


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def commit(spark: SparkSession, folder: str, name: str) -> None:
    """Puts down the marker of a piece that is written. Twice is the same as once."""
    at, system = _system(spark, f"{folder}/_committed/{name}")
    system.create(at, True).close()


def committed(spark: SparkSession, folder: str) -> list[str]:
    """The names of the committed pieces, in order."""
    at, system = _system(spark, f"{folder}/_committed")
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def read_committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of the committed pieces; a piece that was left behind without a marker isn't read."""
    paths = [f"{folder}/{name}" for name in committed(spark, folder)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def memoised(requests: DataFrame, call: Callable[[dict], str], folder: str, pieces: int = 16, **waits) -> DataFrame:
    """requests (key and what call needs) with reply, error, and cached: whether the reply was there before this run.
    Keys that no committed piece has are called, once each, in pieces by their hash; replies are written sorted by key, so
    that later lookups skip files, and committed piece by piece. Calls that fail are not kept, and are made again by the
    next run. waits: see made()."""
    spark = requests.sparkSession
    before = read_committed(spark, folder, REPLIES)
    asked = keep(requests, "requests")
    failed = _answered(asked, before, call, folder, pieces, **waits)
    return _told(asked, before, read_committed(spark, folder, REPLIES), failed)


def _answered(asked: DataFrame, before: DataFrame, call: Callable[[dict], str], folder: str, pieces: int, **waits) -> DataFrame:
    """Calls for the keys of asked that before lacks, and commits the replies; returns key, error of calls that failed.
    Requests are read from where they lie, a piece at a time, and a piece's replies lie twice only until it is committed."""
    spark, known, run = asked.sparkSession, before.select("key").distinct(), uuid.uuid4().hex
    failed = spark.createDataFrame([], f"key {asked.schema['key'].dataType.simpleString()}, error string")
    for i in range(pieces):  # a few jobs, each of many tasks; the number doesn't grow with the requests
        part = asked.where(F.pmod(F.xxhash64("key"), F.lit(pieces)) == i).join(known, "key", "left_anti")
        with kept_for(made(part, call, **waits), "replies") as got:
            good, bad = got.where("reply is not null").select("key", "reply"), got.where("reply is null").select("key", "error")
            if not bad.isEmpty():
                failed = failed.union(keep(bad, "failed"))
            if not good.isEmpty():
                good.sort("key").write.option("compression", "zstd").parquet(f"{folder}/{run}-{i}")
                commit(spark, folder, f"{run}-{i}")
    return failed


def _told(asked: DataFrame, before: DataFrame, replies: DataFrame, failed: DataFrame) -> DataFrame:
    old = before.select("key").distinct().withColumn("cached", F.lit(True))
    now = with_cache(asked, replies).drop("cached")
    return now.join(old, "key", "left").join(failed, "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def compacted(spark: SparkSession, folder: str) -> int:
    """Writes the committed replies as one piece, one row a key, commits it and removes the markers it replaces; returns
    how many those were. A run in between sees the old pieces, both, or the new one: the same replies."""
    old = committed(spark, folder)
    if len(old) > 1:
        name = f"all-{uuid.uuid4().hex}"
        read_committed(spark, folder, REPLIES).groupBy("key").agg(F.min("reply").alias("reply")).sort("key").write.parquet(f"{folder}/{name}")
        commit(spark, folder, name)
        for piece in old:
            for at in (f"{folder}/_committed/{piece}", f"{folder}/{piece}"):
                path, system = _system(spark, at)
                system.delete(path, True)
    return len(old)


def labelled(seeds: DataFrame, call: Callable[[dict], str], folder: str, system: str, retries: int = 2, pieces: int = 16, **waits) -> DataFrame:
    """The log (id, attempt, reply) of seeds (id, text), asked until a reply passes or retries + 1 attempts are made. Each
    round asks what is open, in pieces by the ids' hash; a piece's replies are committed to the log as they have come, so
    that a run that was stopped goes on from the log. Seeds are read once: what a round leaves open moves on to the next one
    with its text, and each reply is judged once. Nothing of that shuffles. Only where ids occur more than once is each
    round planned from the log, and equal requests are called once. The set shrinks, and there are retries + 1 rounds at
    most. A call that fails for good counts as an attempt without a reply."""
    spark, kind, at = seeds.sparkSession, seeds.schema["id"].dataType.simpleString(), f"{folder}/log"
    run, turn, repeated = uuid.uuid4().hex, 0, None

    def log() -> DataFrame:
        return read_committed(spark, at, LOG.format(kind=kind))

    todo = calls.still_open(seeds, log(), retries) if committed(spark, at) else calls.untried(seeds)
    with folder_for(spark, "rounds") as own:
        while True:
            piece = F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int")
            path, answers = f"{own}/open-{turn}", f"{own}/answers-{turn}"
            _packed(todo.withColumn("piece", piece)).partitionBy("piece").parquet(path)
            delete(spark, f"{own}/answers-{turn - 1}")
            open_ = spark.read.schema(f"id {kind}, text string, attempts long, reply string, error string, piece int").parquet(path)
            if open_.isEmpty():
                return log()
            if repeated is None:
                repeated = not open_.groupBy("id").count().where("count > 1").isEmpty()
            for i in range(pieces):
                _packed(_asked(open_.where(F.col("piece") == i), call, system, repeated, **waits)).parquet(f"{answers}/{i}")
                got = spark.read.schema(ANSWERS.format(kind=kind)).parquet(f"{answers}/{i}")
                if not got.isEmpty():
                    name = f"{run}-{turn:04d}-{i}"
                    _packed(got.drop("text")).parquet(f"{at}/{name}")
                    commit(spark, at, name)
            delete(spark, path)
            got = spark.read.schema(ANSWERS.format(kind=kind)).parquet(*(f"{answers}/{i}" for i in range(pieces)))
            if got.where(F.col("attempt") <= retries).isEmpty():
                return log()
            todo = calls.still_open(seeds, log(), retries) if repeated else calls.refused(got, retries)
            turn += 1


def _packed(df: DataFrame):
    return df.write.option("compression", "zstd")


def _asked(open_: DataFrame, call: Callable[[dict], str], system: str, repeated: bool, **waits) -> DataFrame:
    """id, text, attempt, reply of still_open() rows, called where they lie."""
    told = F.concat_ws("\x1f", F.col("id").cast("string"), F.col("attempt").cast("string"), F.to_json("messages"), F.col("temperature").cast("string"), F.col("constrained").cast("string"))
    asked = calls.requests_of(open_, system, "text").withColumn("key", F.sha2(told, 256))
    asked = asked.dropDuplicates(["key"]) if repeated else asked
    got = calls.answered(asked, call, ("id", "text", "attempt"), ("text",), **waits)
    return got.select("id", "text", "attempt", F.coalesce("reply", F.lit("")).alias("reply"))
