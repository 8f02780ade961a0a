"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

One edit lies in the first or in the second half of a word, and leaves the other half intact. So every word goes into the
dictionary sorted from the front, under its first half, and into the one sorted from the back, under its second half; as
an edit may change the length by one, also under the halves of a word that is one shorter. A range of either dictionary is
scanned in order: words that share a half form a block, and the pairs of a block are verified.

A block of more than BLOCK words is subdivided: the window in which the edit may lie is halved again, and its words go on
under the longer prefix or suffix that is then intact. At a window of one place a block can't be larger than the alphabet
allows. Nothing is dropped, whatever the size of a block; a pair is verified once, in the window of its first difference.

Each task tells a word how many near words it has found and the most frequent of them; partial answers of the blocks meet
by word. Roots follow forms by pointer doubling (frequencies at least double along a path, so paths are short).

Defined cases: a null text has no words; a null doc_id is the empty text in the hash; rows that repeat doc_id count like
others; very long words (over WIDE letters) are compared one by one; ties in frequency go to the word that sorts first;
an empty table gives no rows; extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, keep, partitions

RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block that are compared pair by pair; a larger one is subdivided.
BLOCK = 48
#: Words of a scan that numpy compares at once, and the length up to which it does.
SCAN, WIDE = 1 << 15, 48


def damaged_words(docs: DataFrame, every: int = 97) -> DataFrame:
    """word: the lower-cased runs of letters of each text; where `every` divides the hash of id and word, one letter goes."""
    run = F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN), F.lit(0)))
    plain = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), run.alias("w"))
    low = plain.select("d", F.when(F.octet_length("w") == F.length("w"), F.lower("w")).otherwise(F.translate("w", _UPPER, _LOWER)).alias("w"))
    hashed = low.select("w", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("w")).cast("int")
    less = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
    return hashed.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("w")).alias("word"))


def dictionary(words: DataFrame, letters: int = 5, times: int = 3) -> DataFrame:
    """word, n: words of so many letters and occurrences, at least."""
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _blocks(words: DataFrame) -> DataFrame:
    """Each word under the halves of its length and of one less: base (the shorter word's length), the window lo to hi in
    which the edit lies, what is intact before and after it, as it is in the dictionary."""
    long = F.length("word")
    base = words.select("word", "n", F.explode(F.array(long, long - 1)).alias("base"))
    half = F.floor(F.col("base") / 2).cast("int")
    forward = base.select("word", "n", "base", half.alias("lo"), F.col("base").alias("hi"))
    return forward.union(base.select("word", "n", "base", F.lit(0), half))


def _intact() -> tuple:
    """What is before the window, and what is behind it."""
    return F.substr("word", F.lit(1), F.col("lo")), F.right("word", F.col("base") - F.col("hi"))


def _keyed(blocks: DataFrame) -> DataFrame:
    before, after = _intact()
    return blocks.withColumn("before", before).withColumn("after", after)


def subdivided(blocks: DataFrame, most: int = BLOCK) -> DataFrame:
    """The blocks with every large one cut: its window is halved until it is small or the window has one place."""
    key, done, now = ["base", "lo", "hi", "before", "after"], None, _keyed(blocks)
    while True:
        now = keep(now, "blocks")
        large = now.groupBy(*key).agg(F.count("*").alias("size")).where((F.col("size") > most) & (F.col("hi") - F.col("lo") > 1)).drop("size")
        large = keep(large, "large")
        if large.isEmpty():
            return now if done is None else done.union(now)
        small = now.join(large, key, "left_anti").select(now.columns)
        done = small if done is None else done.union(small)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
        cut = now.join(large, key, "left_semi").select("word", "n", "base", F.explode(halves).alias("half"))
        now = _keyed(cut.select("word", "n", "base", "half.lo", "half.hi"))


def _apart(u: str, v: str) -> int:
    """The first place that differs if v is u with one letter replaced or inserted, else -1."""
    if len(u) > len(v):
        u, v = v, u
    p = next((i for i, (a, b) in enumerate(zip(u, v, strict=False)) if a != b), len(u))
    return p if u != v and u[p + (len(u) == len(v)) :] == v[p + 1 :] else -1


def _matrix(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The letters (one byte each), padded, from the front and from the back."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row, start = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(flat)) - start
    front, back = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    front[row, at] = flat
    back[row, np.repeat(size, size) - 1 - at] = flat
    return front, back


def _verify(words: list[str], base: np.ndarray, hi: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of places are near, with the first difference in the block's window."""
    size = np.array([len(w) for w in words], np.int64)
    near = np.zeros(len(i), bool)
    width = int(min(WIDE, size.max()))
    slim = np.flatnonzero(size <= width)
    front, back = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    front[slim], back[slim] = _matrix([words[k] for k in slim], width)
    for lo in range(0, len(i), SCAN):
        a, b = i[lo : lo + SCAN], j[lo : lo + SCAN]
        differ = front[a] != front[b]
        p = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        differ = back[a] != back[b]
        q = np.where(differ.any(axis=1), differ.argmax(axis=1), width)  # letters that agree from the back
        short, long = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        ok = (long <= width) & (np.minimum(p, short) + np.minimum(q, short) >= long - 1) & ((long > short) | (p < short))
        ok &= (long == base[a]) | (short == base[a]) & (long == base[a] + 1)
        near[lo : lo + SCAN] = ok & ((np.minimum(p, short) < hi[a]) | (hi[a] == base[a]))
    for k in np.flatnonzero(np.maximum(size[i], size[j]) > width):
        u, v = words[i[k]], words[j[k]]
        p = _apart(u, v)
        near[k] = p >= 0 and min(len(u), len(v)) == base[i[k]] and (p < hi[i[k]] or hi[i[k]] == base[i[k]])
    return near


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a range of a dictionary in order: word, n_near, and the best near word's n and itself, of each block's pairs.
    The rows of a block follow each other; a block that goes on in the next batch waits for it."""
    held: pa.Table | None = None

    def met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        base, hi, new = rows.column("base").to_numpy(), rows.column("hi").to_numpy(), rows.column("block").to_numpy()
        begins = np.flatnonzero(np.concatenate(([True], new[1:] != new[:-1])))
        end = np.repeat(np.append(begins[1:], len(words)), np.diff(np.append(begins, len(words))))
        place, step = np.arange(len(words)), 1
        got_a, got_b = [], []
        while True:
            i = place[place + step < end]
            if not len(i):
                break
            near = _verify(words, base, hi, i, i + step)
            got_a.append(i[near])
            got_b.append(i[near] + step)
            step += 1
        if not got_a:
            return
        a, b = np.concatenate(got_a), np.concatenate(got_b)
        whose, other = np.concatenate((a, b)), np.concatenate((b, a))
        if not len(whose):
            return
        text = pa.array(words, pa.string())
        yield pa.RecordBatch.from_arrays([text.take(pa.array(whose)), pa.array(n[other]), text.take(pa.array(other))], names=["word", "near_n", "near"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if rows.num_rows < SCAN:
            held = rows.combine_chunks()
            continue
        block = rows.column("block").to_numpy()
        other = block[::-1] != block[-1]
        last = len(block) - int(np.argmax(other)) if other.any() else 0
        held = rows.slice(last).combine_chunks()
        if last:
            yield from met(rows.slice(0, last).combine_chunks())
    if held is not None and held.num_rows:
        yield from met(held)


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, n_near long, best struct<n, word>: of each word of the dictionary (word, n) that has near ones."""
    blocks = subdivided(_blocks(words), most)
    key = ["base", "lo", "hi", "before", "after"]
    # a window at the end reads the dictionary from the front, one at the beginning from the back
    side = (F.col("hi") == F.col("base")).alias("forward")
    ranged = blocks.withColumn("forward", side).withColumn("back", F.reverse("after"))
    order = ["forward", "before", "back", "base", "lo", "hi"]
    dealt = ranged.repartitionByRange(partitions(words.sparkSession) * 2, *order).sortWithinPartitions(*order, "word")
    rows = dealt.select("word", "n", "base", "hi", F.xxhash64(*key).alias("block"))
    pairs = rows.mapInArrow(_scan, "word string, near_n long, near string")
    return pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): the last word that forms lead to. Each round doubles the steps taken."""
    now = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        told = keep(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = told.select("word", "root")
        if told.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root string; n, n_near, form_n long, of a dictionary (word, n): form is the near word of largest n if
    that is at least `times` n."""
    words = keep(words, "words")
    best = words.join(near_words(words), "word", "left")
    taken = -F.col("best.less") >= times * F.col("n")
    out = keep(best.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "variants")
    rooted = out.join(roots(out.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(dictionary(damaged_words(documents(spark, sf_dir).select("doc_id", "text"))))
