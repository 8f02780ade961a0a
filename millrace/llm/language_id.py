"""Language identification: multinomial naive Bayes over hashed character n-grams.

The counts of every training row by language and bucket make the log-probability matrix (buckets x languages). It is
broadcast as the counts that aren't zero (six bytes each: at most buckets x languages of them, 98 KB a language, and no
more than a rare language has n-grams), so a column of very many values, most of them rare, costs little. Whole texts are
scored in numpy, batch by batch, against TOGETHER languages at a time, whose part of the matrix is laid out then; so
memory doesn't grow with the number of languages, and neither buckets nor predictions depend on it.

Defined cases: a null text, or one without a letter, is `und` with score 0; with no training row every text is `und`;
equal posteriors go to the language that sorts first; rows with a null or repeated doc_id are scored like any other; an
empty table gives no rows; a very long text is counted in pieces of CHARS characters, none lost between them; columns of
the input beyond doc_id, text and lang are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, mix, remainder, sliced

LETTER = regex.compile(r"\p{L}")
#: Characters that the numpy passes take at once.
CHARS = 1 << 17
#: Bytes of texts that become Python strings at once.
SLICE = 1 << 20
#: Languages that a text is scored against at once, n-grams that are looked up at once, and counts that a task holds before
#: it adds them up.
TOGETHER, LOOKED_UP, HELD = 64, 1 << 16, 1 << 19


def _grams(texts: list[str], orders: tuple[int, ...], buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, buckets of all n-grams, offsets of the texts in them), in runs of about CHARS characters."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > CHARS:  # windows that begin in a piece may end in the next
            for a in range(0, len(texts[i]), CHARS):
                piece = np.frombuffer(texts[i][a : a + CHARS + max(orders) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
                for order in orders:
                    m = max(0, min(CHARS, len(piece) - order + 1))
                    h = np.zeros(m, np.uint64)
                    for k in range(order):
                        h = h * np.uint64(0x100000001B3) + piece[k : k + m]
                    yield i, i + 1, (mix(h + np.uint64(order)) % np.uint64(buckets)).astype(np.int32), np.array([0, m])
            i += 1
            continue
        j, n = i, 0
        while j < len(texts) and len(texts[j]) <= CHARS and (j == i or n + len(texts[j]) <= CHARS):
            n += len(texts[j]) + 1
            j += 1
        size = np.array([len(t) for t in texts[i:j]], np.int64)
        codes = np.frombuffer("".join(texts[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        off = np.concatenate(([0], np.cumsum(size)))
        keys, ends = [], []
        for order in orders:  # n-grams that begin in a text and end in it: the windows across texts fall out
            ok = np.ones(len(codes), bool)
            for k in range(1, order):
                ok[(off[1:] - k)[off[1:] - k >= off[:-1]]] = False
            starts = np.flatnonzero(ok)
            h = np.zeros(len(starts), np.uint64)
            for k in range(order):
                h = h * np.uint64(0x100000001B3) + codes[starts + k]
            keys.append((mix(h + np.uint64(order)) % np.uint64(buckets)).astype(np.int32))
            ends.append(np.searchsorted(starts, off))
        for keyed, own in zip(keys, ends, strict=True):
            yield i, j, keyed, own
        i = j


@dataclass
class Model:
    """langs (sorted), their n-grams, and of each language the buckets that it has and how often, from start on."""

    langs: list[str]
    total: np.ndarray
    start: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    buckets: int

    def logs(self, lo: int, hi: int) -> np.ndarray:
        """The matrix (buckets x languages lo to hi, float32) of log probabilities, add-one smoothed."""
        dense = np.zeros((self.buckets, hi - lo))
        at = slice(self.start[lo], self.start[hi])
        dense[self.bucket[at], np.repeat(np.arange(hi - lo), np.diff(self.start[lo : hi + 1]))] = self.count[at]
        return np.log((dense + 1) / (self.total[lo:hi] + self.buckets)).astype(np.float32)


def train(df: DataFrame, orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 14) -> Model:
    """df: lower-cased text, lang. Every row counts: each task adds up what it has read by language and bucket, and Spark
    adds up the tasks' sums."""

    def told(langs: list[str], held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        kinds, back = np.unique(keys, return_inverse=True)
        return kinds, np.bincount(back, n).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[str, int] = {}
        held, size = [], 0
        for batch in sliced(batches, 0, SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own_code = np.array([code.setdefault(x, len(code)) for x in batch.column("lang").to_pylist()], np.int64)
            for i, j, keyed, own in _grams(texts, orders, buckets):
                keys, n = np.unique(np.repeat(own_code[i:j], np.diff(own)) * buckets + keyed[own[0] : own[-1]], return_counts=True)
                held.append((keys, n))
                size += len(keys)
                if size > HELD:
                    held = [told(list(code), held)]
                    size = len(held[0][0])
                    if 2 * size > HELD:  # very many languages: what is there goes on its way
                        yield from rows(list(code), *held[0])
                        held, size = [], 0
        if held:
            yield from rows(list(code), *told(list(code), held))

    def rows(langs: list[str], keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = pa.array(langs, pa.string())
        for lo in range(0, len(keys), 1 << 16):
            k = keys[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(k // buckets)), pa.array((k % buckets).astype(np.int32)), pa.array(n[lo : lo + (1 << 16)])], names=["lang", "bucket", "n"])

    by_task = df.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    found = by_task.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    names, counts = found.column("lang").to_numpy(zero_copy_only=False), found.column("n").to_numpy()
    langs, code = np.unique(names.astype(str), return_inverse=True) if len(names) else (np.zeros(0, str), np.zeros(0, np.int64))
    order = np.argsort(code, kind="stable")
    total = np.bincount(code, counts, minlength=len(langs)) if len(langs) else np.zeros(0)
    start = np.searchsorted(code[order], np.arange(len(langs) + 1))
    return Model([str(x) for x in langs], total, start, found.column("bucket").to_numpy()[order].astype(np.uint16 if buckets <= 1 << 16 else np.int32), counts[order].astype(np.float32 if not len(counts) or counts.max() < 1 << 24 else np.float64), buckets)


def scores(model: Model, texts: list[str], orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the place of the best language and its share of the posterior, at the tempered scale of one hundred
    n-grams. Languages come TOGETHER at a time; the best so far and the others' weight against it are carried on."""
    n = np.zeros(len(texts))
    best, top, weight = np.zeros(len(texts), np.int64), np.full(len(texts), -np.inf), np.zeros(len(texts))
    for lo in range(0, len(model.langs), TOGETHER):
        hi = min(lo + TOGETHER, len(model.langs))
        logs, sums = model.logs(lo, hi), np.zeros((len(texts), hi - lo))
        for i, j, keyed, own in _grams(texts, orders, model.buckets):  # made anew for more languages, so that none are held
            if not lo:
                n[i:j] += np.diff(own)
            for c in range(0, len(keyed), LOOKED_UP):
                d = min(len(keyed), c + LOOKED_UP)
                full = np.flatnonzero(np.minimum(own[1:], d) > np.maximum(own[:-1], c))
                sums[i + full] += np.add.reduceat(logs[keyed[c:d]], np.maximum(own[full] - c, 0), axis=0, dtype=np.float64)
        scale = np.minimum(n, 100) / np.maximum(n, 1)
        here, high = sums.argmax(axis=1), sums.max(axis=1)
        new = np.maximum(top, high)
        with np.errstate(invalid="ignore"):
            weight = np.where(np.isneginf(top), 0, weight * np.exp((top - new) * scale)) + np.exp((sums - new[:, None]) * scale[:, None]).sum(axis=1)
        best, top = np.where(high > top, lo + here, best), new
    return best, np.where(weight > 0, 1 / np.maximum(weight, 1e-300), 0.0)


def identify(df: DataFrame, training: DataFrame, orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 14, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds lang_pred string and score double (the winner's share of the posterior, at the tempered scale of one
    hundred n-grams, so that it falls towards 1 / languages for a text between them) to df, which has a text column.
    into: other names for the two."""
    spark = df.sparkSession
    rows = training.where("text is not null and lang is not null").select(F.lower("text").alias("text"), "lang")
    model = train(rows, orders, buckets)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        for column in columns:
            preds, shares = [], [np.zeros(0)]
            for batch in sliced(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), 0, SLICE):
                texts = [t or "" for t in batch.column(0).to_pylist()]
                best, top = scores(own, texts, orders)
                known = np.array([bool(own.langs) and LETTER.search(t) is not None for t in texts], bool)
                preds += [own.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
                shares.append(np.where(known, top, 0.0))
            yield pa.StructArray.from_arrays([pa.array(preds, pa.string()), pa.array(np.concatenate(shares))], names=["lang_pred", "score"])

    told = score(F.lower("text"))  # only this column moves to Python; both mentions are computed at once
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in into], told["lang_pred"].alias(into[0]), told["score"].alias(into[1]))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    training = docs.where(remainder(F.col("doc_id"), 4) != 2)
    out = identify(docs.select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2), training)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: learns from the labelled rows of docs, and drops a document without a letter or whose best
    language has less than `least` of the posterior. Returns docs' own columns."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text"), F.col("lang"))
    out = identify(plain.drop("lang"), plain.select("text", "lang"), into=("language", "share"))
    return out.where((F.col("language") != "und") & (F.col("share") >= least)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
