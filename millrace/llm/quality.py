"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line that isn't blank is good or bad. What speaks for either are features of the line and of the lines before and
after it (shares of capitals, digits and symbols, lengths, repeated words and lines), each cut into bins at quantiles of
the sample, and the label of its neighbour. Forward-backward over the whole chain gives each line's probability to be
good; their mean, weighted by the lines' lengths, is the document's quality, which a logistic fit maps to a share of
good documents.

Labels are of documents. Lines begin with the label of theirs; then lines of bad documents that look good by themselves
count as good (some bad line stays), and the field is fitted again, so that it learns how labels change along a text.

The field is fitted on the driver, on a bounded sample: at most EXAMPLES labelled documents, in the order of a hash of
their ids, and of each at most LINES lines in a row, beginning at a place that a hash names. Only their features travel.
Every text is scored whole, in Arrow batches.

Defined cases: a null or empty text, or one of white space, has no lines and gets the share of good ones among the
sample's texts without lines, against the prior; with no usable labels every score is 0; labels that repeat a doc_id
count once, as bad if any is; null labels and ids are left out; repeated rows get equal scores; a very long text is
scored as one chain (memory goes with its size); an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, mix, remainder, sliced, utf8, words

U = np.uint64
#: Of the sample: documents, and lines of each, at most.
EXAMPLES, LINES = 4096, 256
#: Bytes of text that are worked on at once (a longer text comes alone).
SLICE = 1 << 20
#: Bins of a feature; bin 0 is that of a line which isn't there.
BINS = 10
ROUNDS, RATE, PENALTY = 120, 0.1, 1e-3
NAMES = ("capitals", "digits", "symbols", "points", "shouts", "word_length", "bytes", "words", "echoes", "distinct", "new", "single", "again", "ends")

_UPPER, _LETTER, _DIGIT, _SPACE, _POINT, _SHOUT, _SYMBOL = range(7)
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = _UPPER, _LETTER, _LETTER, _DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[ord(c) for c in ".,;:'\"-?()"]], _KIND[ord("!")] = _POINT, _SHOUT
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".?!"]] = True


def _first_seen(key: np.ndarray) -> np.ndarray:
    """Whether a key is there for the first time."""
    new = np.zeros(len(key), bool)
    new[np.unique(key, return_index=True)[1]] = True
    return new


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with words: features (float32) and bytes; and the offsets (n + 1) of each text's lines."""
    data, at = utf8(column)
    n = len(at) - 1
    hashed, off, first, end = words(column, spans=True)
    if not len(hashed):
        return np.zeros((0, len(NAMES)), np.float32), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    data, first, end = data[at[0] : at[-1]], first - at[0], end - at[0]  # the column may be a slice of a longer one
    doc = np.repeat(np.arange(n), np.diff(off))
    breaks = np.flatnonzero((data == 10) | (data == 13))
    row = np.searchsorted(breaks, first)  # breaks before a word
    begins = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]))))
    line = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(row))))
    lo, hi = first[begins], end[np.append(begins[1:], len(row)) - 1]  # from the first word to the last
    size = hi - lo
    kind = _KIND[data]
    kinds = np.stack([np.add.reduceat(kind == k, np.stack((lo, hi), axis=1).ravel()[: 2 * len(lo) - (hi[-1] == len(data))], dtype=np.int64)[::2] for k in range(7)], axis=1).astype(np.float64)
    count = np.diff(np.append(begins, len(row))).astype(np.float64)
    per_line = lambda x: np.bincount(line[x], minlength=len(begins))
    echo = np.concatenate(([False], (hashed[1:] == hashed[:-1]) & (line[1:] == line[:-1])))
    distinct = _first_seen(mix(hashed ^ mix(line.astype(U) + U(1))))
    new = _first_seen(mix(hashed ^ mix(doc.astype(U) + U(1))))
    order = np.arange(len(row)) - np.repeat(begins, count.astype(np.int64))
    whole = np.add.reduceat(mix(hashed + order.astype(U)), begins)
    own = doc[begins]
    key = mix(whole ^ mix(own.astype(U) + U(1)))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    letters = kinds[:, _UPPER] + kinds[:, _LETTER]
    features = [
        kinds[:, _UPPER] / np.maximum(letters, 1), kinds[:, _DIGIT] / size, kinds[:, _SYMBOL] / size, kinds[:, _POINT] / size, kinds[:, _SHOUT] / count,
        (size - kinds[:, _SPACE]) / count, np.log2(size), np.log2(count), per_line(echo) / count, per_line(distinct) / count, per_line(new) / count,
        per_line(end - first == 1) / count, np.log2(times[back]), _END[data[hi - 1]],
    ]
    return np.stack(features, axis=1).astype(np.float32), size, np.searchsorted(own, np.arange(n + 1))


@dataclass
class Field:
    """cuts: bin bounds (features x bins - 2); weights (3 x features x bins: before, own, after) and bias: log odds of a
    good line; steps: log potentials of label pairs; scale, shift: of the logistic fit; void: score without lines."""

    cuts: np.ndarray
    weights: np.ndarray
    bias: float
    steps: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    void: float = 0.0

    def bins(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bins (3 x lines x features) of the lines before, of the lines, and of those after."""
        own = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], axis=1).astype(np.int64).reshape(x.shape) + 1
        before, after = np.zeros_like(own), np.zeros_like(own)
        if len(own):
            before[1:], after[:-1] = own[:-1], own[1:]
            start = off[:-1][off[1:] > off[:-1]]
            before[start] = 0
            after[start[1:] - 1] = 0
        return np.stack((before, own, after))

    def odds(self, bins: np.ndarray) -> np.ndarray:
        at = np.arange(len(self.cuts))
        return self.bias + sum(self.weights[k][at, bins[k]].sum(axis=1) for k in range(3))


def marginals(odds: np.ndarray, steps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over each chain: P(good) of each line, and summed probabilities (2 x 2) of label pairs. Chains go
    side by side, longest first."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    start, long = off[:-1][order], n[order]
    alive = np.searchsorted(-long, -np.arange(int(long.max()) if len(long) else 0), "left")  # chains with more than t lines
    own = np.exp(np.minimum(0.0, np.stack((-odds, odds), axis=1)).clip(-60))
    pair = np.exp(steps - steps.max())
    ahead, back = np.ones_like(own), np.ones_like(own)
    for t, m in enumerate(alive):
        at = start[:m] + t
        a = own[at] * (ahead[at - 1] @ pair if t else 1.0)
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    both = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = start[: alive[t]] + t
        b = own[at] * back[at]
        joint = ahead[at - 1][:, :, None] * pair * b[:, None, :]
        both += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = b @ pair.T
        back[at - 1] = b / b.sum(axis=1, keepdims=True)
    p = ahead * back
    return p[:, 1] / p.sum(axis=1), both


def _climb(field: Field, bins: np.ndarray, good: np.ndarray, off: np.ndarray) -> None:
    """Maximises the penalised likelihood of the labels given the lines, by gradient steps of adaptive size."""
    features, n = len(field.cuts), max(1, len(good))
    same = np.ones(max(0, len(good) - 1), bool)
    same[off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(good))] - 1] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[:-1][same], good[1:][same]), 1)
    place = ((np.arange(3)[:, None, None] * features + np.arange(features)) * BINS + bins).reshape(3, -1)
    told = field.weights.size
    state = np.concatenate((field.weights.ravel(), [field.bias], field.steps.ravel()))
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for t in range(1, ROUNDS + 1):
        field.weights, field.bias, field.steps = state[:told].reshape(field.weights.shape), float(state[told]), state[told + 1 :].reshape(2, 2)
        p, both = marginals(field.odds(bins), field.steps, off)
        over = np.repeat(good - p, features)
        up = sum(np.bincount(place[k], over, minlength=told) for k in range(3))
        slope = np.concatenate((up, [(good - p).sum()], (seen - both).ravel())) / n - PENALTY * state
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        state = state + RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    field.weights, field.bias, field.steps = state[:told].reshape(field.weights.shape), float(state[told]), state[told + 1 :].reshape(2, 2)


def _share(p: np.ndarray, size: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The mean of p by text, weighted by the lines' lengths; nan for texts without lines."""
    full = off[1:] > off[:-1]
    out = np.full(len(full), np.nan)
    if full.any():
        start = off[:-1][full]
        out[full] = np.add.reduceat(p * size, start) / np.add.reduceat(size.astype(np.float64), start)
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(x: np.ndarray, size: np.ndarray, off: np.ndarray, good: np.ndarray) -> Field:
    """A field of the sample's lines (features, bytes, offsets of the documents) and the documents' labels."""
    cuts = np.quantile(x, np.linspace(0, 1, BINS)[1:-1], axis=0).T if len(x) else np.zeros((len(NAMES), BINS - 2))
    prior = float(good.mean())
    field = Field(np.ascontiguousarray(cuts), np.zeros((3, len(NAMES), BINS)), 0.0, np.zeros((2, 2)))
    bins, label = field.bins(x, off), np.repeat(good, np.diff(off))
    _climb(field, bins, label, off)
    alone = 1 / (1 + np.exp(-field.odds(bins)))
    worst = np.ones(len(good))
    full = off[1:] > off[:-1]
    if full.any():
        worst[full] = np.minimum.reduceat(alone, off[:-1][full])
    clean = (label == 0) & (alone > 0.9) & (alone > np.repeat(worst, np.diff(off)))
    _climb(field, bins, np.where(clean, 1, label), off)
    z = _logit(_share(marginals(field.odds(bins), field.steps, off)[0], size, off)[full])
    y, w = good[full].astype(float), np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps of a penalised logistic fit
        p = 1 / (1 + np.exp(-(w[0] * z + w[1])))
        slope = np.array([((y - p) * z).sum() - (w[0] - 1), (y - p).sum() - w[1] * 0.1])
        v = p * (1 - p)
        curve = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        w = w + np.clip(np.linalg.solve(curve, slope), -1, 1)
    field.scale, field.shift = max(float(w[0]), 1e-3), float(w[1])
    field.void = float((good[~full].sum() + prior) / ((~full).sum() + 1))
    return field


def train(labelled: DataFrame) -> Field | None:
    """A field of labelled (doc_id, text, good): rows with null ids or labels left out; None where there is no row."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, SLICE):
            x, size, off = lines(batch.column(1))
            keys = batch.column(0).to_pylist()
            got_x, got_size = [], []
            for i, key in enumerate(keys):
                lo, n = int(off[i]), int(off[i + 1] - off[i])
                lo += key % (n - LINES + 1) if n > LINES else 0
                got_x.append(x[lo : lo + min(n, LINES)].tobytes())
                got_size.append(size[lo : lo + min(n, LINES)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got_x, pa.binary()), pa.array(got_size, pa.binary()), batch.column(2)], names=["key", "x", "size", "good"])

    rows = labelled.where("doc_id is not null and good is not null").select(F.xxhash64("doc_id").alias("key"), "text", F.col("good").cast("int").alias("good"))
    sample = sorted(rows.mapInArrow(told, "key long, x binary, size binary, good int").orderBy("key", "x", "good").limit(EXAMPLES).collect())
    if not sample:
        return None
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, len(NAMES)) for r in sample]
    off = np.concatenate(([0], np.cumsum([len(x) for x in xs])))
    return fit(np.concatenate(xs), np.concatenate([np.frombuffer(r["size"], np.int64) for r in sample]), off, np.array([r.good for r in sample]))


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """The rows of docs (text and others) with score double instead of the text."""
    others = [c for c in docs.columns if c != "text"]
    if field is None:
        return docs.select(*others, F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in sliced(batches, len(others), SLICE):
            x, size, off = lines(batch.column(len(others)))
            p, _ = marginals(own.odds(own.bins(x, off)), own.steps, off)
            share = _share(p, size, off)
            told = np.where(np.isnan(share), own.void, 1 / (1 + np.exp(-(own.scale * _logit(np.nan_to_num(share)) + own.shift))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(told)], names=[*others, "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "score double"])
    return docs.select(*others, "text").mapInArrow(work, schema)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null and quality is not null").where(~held_out)
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("good"))
    # as many labels as the sample may need reach every task: bounded, whatever the tables
    taken = labels.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    field = train(docs.join(F.broadcast(taken), "doc_id"))
    out = score(docs.withColumn("held_out", held_out), field)
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int")).select("doc_id", "held_out", "score", "predicted")
