"""Calls of a labelling model as tables: requests, a cache of replies, attempts, and the boundary where calls are made."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import prompts
from millrace.functions.normalise import content_id, let
from millrace.operators.gate import batch_texts, first_json, validate

#: Names of callers: provider name to a function that makes one from its options.
PROVIDERS: dict[str, Callable[..., Callable[[dict], str]]] = {}
# What marks errors that pass by themselves, in an exception's type name or message, in lower case.
PASSING = ("ratelimit", "rate_limit", "overloaded", "timeout", "timed out", "connection", "apiconnection", "internalserver", "internal server", "529", "500", "502", "503", "504")


def register(name: str):
    def add(make: Callable[..., Callable[[dict], str]]):
        PROVIDERS[name] = make
        return make

    return add


def provider(name: str, **options) -> Callable[[dict], str]:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name](**options)


def two_passes(seeds: DataFrame) -> DataFrame:
    """Requests (id, text, pass, salt) of labelling and of the consistency pass, which differs in its salt."""
    passes = F.array(*[F.struct(F.lit(n).alias("pass"), F.lit(salt).alias("salt")) for n, salt in ((1, ""), (2, "consistency"))])
    return seeds.select("id", "text", F.inline(passes))


def with_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests with reply and cached. cache: key, reply; of repeated keys the smallest reply counts, so that reruns
    agree. Both sides shuffle by key; AQE broadcasts the cache where it is small."""
    once = cache.groupBy("key").agg(F.min("reply").alias("reply"))
    return requests.join(once, "key", "left").withColumn("cached", F.col("reply").isNotNull())


def passes(error: Exception) -> bool:
    """Whether an error may pass by itself, by its type's name or its message."""
    told = f"{type(error).__name__}\n{error}".lower()
    return any(mark in told for mark in PASSING)


def answered(requests: DataFrame, call: Callable[[dict], str], keep: tuple[str, ...], unseen: tuple[str, ...] = (), tries: int = 6, base: float = 2.0, most: float = 60.0) -> DataFrame:
    """The columns `keep` of requests with reply and error: each row is called where it lies, on the executors, with all
    columns but the unseen ones. Nothing shuffles. Passing errors (passes()) are waited out: base seconds, doubled each
    time, and up to a second more, at most `most`; a call that fails for good has error."""
    shown = [c for c in requests.columns if c not in unseen]

    def ask(row: dict) -> tuple[str | None, str | None]:
        for n in range(tries):
            try:
                return call(row), None
            except Exception as e:  # a provider may raise anything; it is told apart by its message, and kept
                said = str(e)
                if n == tries - 1 or not passes(e):
                    return None, said
                time.sleep(min(most, base * 2**n + random.random()))
        return None, "no tries"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [ask(r) for r in part.select(shown).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array([g[k] for g in got], pa.string()) for k in (0, 1))], names=[*keep, "reply", "error"])

    kinds = [f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in keep]
    return requests.mapInArrow(run, ", ".join([*kinds, "reply string", "error string"]))


def made(requests: DataFrame, call: Callable[[dict], str], **waits) -> DataFrame:
    """key, reply, error of requests, called once per distinct key. waits: see answered()."""
    return answered(requests.dropDuplicates(["key"]), call, ("key",), **waits)


def _checked(log: DataFrame) -> tuple[DataFrame, Column, Callable[[Column], Column]]:
    """log with the JSON of its reply, the check of that, and what makes the error of a check."""
    found = log.withColumn("_json", first_json(F.col("reply")))
    checked = validate(F.col("_json"))
    error = lambda c: F.when(F.col("_json").isNull(), "no JSON found").when(F.size(c["errors"]) > 0, F.array_join(c["errors"], ", "))
    return found, checked, error


def judged(log: DataFrame) -> DataFrame:
    """log (id, attempt, reply) with invoice and error (null where the reply passes)."""
    found, checked, error = _checked(log)
    out = found.withColumn("_checked", checked)
    return out.withColumn("invoice", F.col("_checked.invoice")).withColumn("error", error(F.col("_checked"))).drop("_json", "_checked")


def resolve(log: DataFrame, retries: int = 2) -> DataFrame:
    """Per id: valid, attempts, invoice, reply, error: the first attempt that passes, else the last one's error. Attempts
    beyond retries + 1, and those after one that passes, count for nothing. One aggregation with partial sums."""
    rows = judged(log.where(F.col("attempt") <= retries + 1))
    passed = F.col("error").isNull()
    rank = F.when(passed, F.col("attempt"))
    by = rows.groupBy("id").agg(
        F.min(rank).alias("first"),
        F.min_by(F.struct("invoice", "reply"), rank).alias("good"),
        F.max("attempt").alias("last"),
        F.max_by(F.struct("reply", "error"), "attempt").alias("bad"),
    )
    valid = F.col("first").isNotNull()
    return by.select("id", valid.alias("valid"), F.coalesce("first", "last").cast("long").alias("attempts"), F.col("good.invoice").alias("invoice"), F.when(valid, F.col("good.reply")).otherwise(F.col("bad.reply")).alias("reply"), F.when(~valid, F.col("bad.error")).alias("error"))


def extracted(log: DataFrame, retries: int = 2) -> DataFrame:
    """resolve() where a row without a valid reply is an error that tells its id, attempts and last error."""
    told = F.concat(F.lit("no valid reply for "), F.col("id").cast("string"), F.lit(" after "), F.col("attempts").cast("string"), F.lit(" attempt(s): "), F.coalesce("error", F.lit("")))
    found = resolve(log, retries)
    return found.withColumn("invoice", F.when(F.col("valid"), F.col("invoice")).otherwise(F.raise_error(told).cast(found.schema["invoice"].dataType)))


def new_seeds(batches: DataFrame, seen: DataFrame, least: int = 40) -> DataFrame:
    """id, text, source, batch of batches (batch, reply): the texts that are long enough and neither in seen (id) nor in
    an earlier place. An anti join on the content's id; of equal texts the first batch's counts."""
    texts = batches.select("batch", F.posexplode(batch_texts(F.col("reply"), least)).alias("at", "text"))
    keyed = texts.withColumn("id", content_id(F.col("text")))
    first = keyed.groupBy("id").agg(F.min_by(F.struct("text", "batch"), F.struct("batch", "at")).alias("w"))
    return first.join(seen.select("id"), "id", "left_anti").select("id", "w.text", F.lit("teacher").alias("source"), "w.batch")


def until(spark: SparkSession, n: int, ask: Callable[[int, int], str], known: list[str] = (), per_call: int = 10, misses: int = 50, least: int = 40) -> DataFrame:
    """id, text, source of n new texts (more where the last reply has more than was asked for), or fewer after so many
    replies without a new one. ask(batch, want) gives a reply; known are ids that count as seen. A loop on the driver, as
    every call depends on what the ones before gave; it holds the n texts. Replies are read and texts identified by the same expressions as new_seeds()."""
    found: dict[str, tuple] = {}
    seen, batch, missed = set(known), 0, 0
    while len(found) < n and missed < misses:
        reply = spark.createDataFrame([(batch, ask(batch, min(per_call, n - len(found))))], "batch long, reply string")
        fresh = reply.select(F.posexplode(batch_texts(F.col("reply"), least)).alias("at", "text")).select("at", "text", content_id(F.col("text")).alias("id"))
        before = len(found)
        for row in sorted(fresh.collect()):
            if row.id not in seen:
                seen.add(row.id)
                found[row.id] = (row.id, row.text, "teacher")
        missed += len(found) == before
        batch += 1
    return spark.createDataFrame(list(found.values()), "id string, text string, source string")


def still_open(seeds: DataFrame, log: DataFrame, retries: int = 2) -> DataFrame:
    """id, text, attempts, reply, error of seeds (id, text) that no reply of the log passed for and that have attempts left,
    with the last refused reply; 0 attempts where the log has none. Of the log only refused replies move, and their errors."""
    tried = judged(log.where(F.col("attempt") <= retries + 1))
    refused = F.struct(F.when(F.col("error").isNotNull(), F.col("reply")).alias("reply"), "error")
    state = tried.select("id", "attempt", F.col("error").isNull().alias("passed"), refused.alias("refused")).groupBy("id").agg(F.bool_or("passed").alias("valid"), F.max("attempt").alias("attempts"), F.max_by("refused", "attempt").alias("last"))
    state = state.select("id", "valid", "attempts", "last.reply", "last.error")
    met = seeds.join(state, "id", "left").where("valid is null or (not valid and attempts <= %d)" % retries)
    return met.select("id", "text", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), "reply", "error")


def untried(seeds: DataFrame) -> DataFrame:
    """still_open() of seeds without a log."""
    return seeds.select("id", "text", F.lit(0).cast("long").alias("attempts"), *(F.lit(None).cast("string").alias(c) for c in ("reply", "error")))


def refused(answers: DataFrame, retries: int = 2) -> DataFrame:
    """still_open() of answers (id, text, attempt, reply), one a seed, by themselves: each reply is judged once, when it has
    come, and nothing shuffles. Rows that pass are left out by an empty list: a filter by the error would be moved below the
    check and make it twice."""
    found, checked, error = _checked(answers.where(F.col("attempt") <= retries))
    wrong = F.filter(F.array(let(checked, error)), lambda e: e.isNotNull())
    return found.select("id", "text", F.col("attempt").alias("attempts"), "reply", F.explode(wrong).alias("error"))


def requests_of(open_: DataFrame, system: str, *keep: str) -> DataFrame:
    """What to ask (id, attempt, messages, temperature, constrained, and the columns `keep`) of still_open() rows. The first
    attempt is free at 0, later ones constrained at 0.3."""
    first = F.col("attempts") == 0
    base = F.array(prompts.turn("system", F.lit(system)), prompts.turn("user", prompts.user_prompt(F.col("text"))))
    messages = F.when(first, base).otherwise(prompts.retry_messages(system, F.col("text"), F.col("reply"), F.col("error")))
    return open_.select("id", (F.col("attempts") + 1).alias("attempt"), messages.alias("messages"), F.when(first, 0.0).otherwise(0.3).alias("temperature"), (~first).alias("constrained"), *keep)


def next_requests(seeds: DataFrame, log: DataFrame, system: str, retries: int = 2) -> DataFrame:
    """What to ask next (see requests_of()): first attempts of seeds (id, text) without a log, and repairs of those whose
    last reply failed."""
    return requests_of(still_open(seeds, log, retries), system)
