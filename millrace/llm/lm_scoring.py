"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and of word pairs in the training texts are quantised by logarithm; level 1 to q of an n-gram are put
into a Bloom filter, and probing level after level until one is missing gives the count back. A pair's probability
is its count smoothed towards the word's own: (c(v, w) + MU * p(w)) / (c(v) + MU), p(w) = (c(w) + 1) / (N + V + 1).

Counting: tasks sum up n-grams before they send them, packed, to a part of the hash space; each part builds its own
segment of the filter. A filter of at most MOST_BYTES, as measured, is broadcast whole, and texts are scored at once. A
larger one is never brought together: texts travel in batches, each batch asks the parts for the levels of its distinct
n-grams, the parts probe their segments, and the answers meet the batch again. Both ways probe the same filter, so
scores are the same; the driver holds MOST_BYTES at most, whatever the data.

The exact base score needs exact word counts. Words that are more than 1 / FREQUENT of all tokens (at most FREQUENT
words, whatever the data) are broadcast with their counts; the others' occurrences meet their counts in the parts, so
that no part holds a frequent word's occurrences.

Defined cases: null text is empty: one token, the end; with no training text all counts are 0; equal rows get equal
scores; a null doc_id is the empty text to the rule, so such rows are trained on; very long texts are hashed in pieces, and each is scored
in one array of its tokens; an empty table gives no rows; extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, keep, mix, partitions, remainder, sliced, words

U = np.uint64
END = U(0x00E4D00E4D00E4D1)
#: Words with more than 1 / FREQUENT of the tokens are broadcast with their counts.
FREQUENT = 50_000
STEP, BITS, HASHES, MU = 1.5, 10, 5, 100.0
#: N-grams that a task holds before it sends their sums.
HELD = 1 << 22
#: Bytes of a filter that may be broadcast.
MOST_BYTES = 256 << 20


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and offsets."""
    hashed, off = words(column)
    to = off + np.arange(len(off))
    out = np.empty(to[-1], U)
    out[to[1:] - 1] = END
    inside = np.ones(len(out), bool)
    inside[to[1:] - 1] = False
    out[inside] = hashed
    return out, to


def pairs(token: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it (END before the first)."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[off[:-1]] = END
    return mix(before * U(0x9FB21C651E98DF25) + token)


def level(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(STEP) + 1e-9), 0).astype(np.int64)


#: The count that a level stands for: the geometric middle of the whole numbers that have it.
_low = np.ceil(STEP ** np.arange(0, 120) - 1e-9)
MIDDLE = np.concatenate(([0.0], np.sqrt(_low[:-1] * np.maximum(_low[:-1], _low[1:] - 1))))


def _bits(key: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    h = mix(key + at.astype(U) * U(0x9E3779B97F4A7C15))
    other = (h >> U(32)) | U(1)
    for i in range(HASHES):
        yield ((h + U(i) * other) % size).astype(np.int64)


def segment(key: np.ndarray, levels: np.ndarray) -> bytes:
    """A Bloom filter of BITS bits per entry: each key at levels 1 to levels[i]."""
    size = max(64, -(-int(levels.sum()) * BITS // 64) * 64)
    on = np.zeros(size, bool)
    for at in range(1, int(levels.max(initial=0)) + 1):
        own = key[levels >= at]
        for b in _bits(own, np.full(len(own), at), np.full(len(own), size, U)):
            on[b] = True
    return np.packbits(on, bitorder="little").tobytes()


def probe(key: np.ndarray, bits: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The level of each key in the segment that begins at byte start of bits and has size bits (0: none): level after
    level is probed, until one is missing."""
    out = np.zeros(len(key), np.int64)
    left = np.flatnonzero(size > 0)
    at = 1
    while len(left):
        hit = np.ones(len(left), bool)
        for b in _bits(key[left], np.full(len(left), at), size[left]):
            hit &= (bits[start[left] + (b >> 3)] >> (b & 7).astype(np.uint8)) & 1 == 1
        left = left[hit]
        out[left] = at
        at += 1
    return out


class Filter:
    """The segments of all parts."""

    def __init__(self, parts: int, segments: list[tuple[int, bytes]]):
        self.parts = parts
        self.size, self.start = np.zeros(parts, U), np.zeros(parts, np.int64)
        at = 0
        for p, raw in segments:
            self.size[p], self.start[p] = len(raw) * 8, at
            at += len(raw)
        self.bytes = np.frombuffer(b"".join(raw for _, raw in segments), np.uint8)

    def found(self, hashed: np.ndarray, pair: bool) -> np.ndarray:
        """The level of each n-gram, by its hash."""
        once, back = np.unique(hashed, return_inverse=True)
        part = (once % U(self.parts)).astype(np.int64)
        return probe(_key(once, part, self.parts, pair), self.bytes, self.start[part], self.size[part])[back]


def _pack(number: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(number.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    return out.view("<u8").ravel()


_WIDTH = {0: 8, 1: 5}  # bytes of a word's hash, and of a pair's beyond its part


def gather(training: DataFrame, parts: int) -> DataFrame:
    """part, words (n), tokens, keys, counts (packed) of its words, bloom: its segment of the filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        n = {0: 0, 1: 0}

        def send(kind: int) -> Iterator[pa.RecordBatch]:
            key, total = np.unique(np.concatenate([x for x, _ in held[kind]]), return_inverse=True)
            total = np.bincount(total, np.concatenate([c for _, c in held[kind]]), len(key)).astype(np.int64)
            part = (key % U(parts)).astype(np.int64)
            order = np.lexsort((total > 1, part))
            key, total, part = key[order], total[order], part[order]
            bound = np.searchsorted(part, np.arange(parts + 1))
            ids, blobs = [], []
            for p in np.flatnonzero(np.diff(bound)):
                own, c = key[bound[p] : bound[p + 1]], total[bound[p] : bound[p + 1]]
                more = c[c > 1]
                short = own if kind == 0 else own // U(parts)
                blobs.append(np.array([len(own), len(more)], "<u4").tobytes() + more.astype("<u8").tobytes() + _pack(short, _WIDTH[kind]))
                ids.append(p)
            held[kind], n[kind] = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([kind] * len(ids), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])

        for batch in sliced(batches, 0):
            token, off = tokens(batch.column(0))
            for kind, own in ((0, np.delete(token, off[1:] - 1)), (1, pairs(token, off))):
                key, c = np.unique(own, return_counts=True)
                held[kind].append((key, c))
                n[kind] += len(key)
                if n[kind] > HELD:
                    yield from send(kind)
        for kind in (0, 1):
            if n[kind]:
                yield from send(kind)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, dict[int, list]] = {}
        for batch in batches:
            for p, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, m = np.frombuffer(blob, "<u4", 2)
                c = np.ones(n, np.int64)
                c[n - m :] = np.frombuffer(blob, "<u8", m, 8)
                got.setdefault(p, {0: [], 1: []})[kind].append((_unpack(blob[8 + 8 * m :], n, _WIDTH[kind]), c))
        for p in sorted(got):
            full = []
            for kind in (0, 1):
                if not got[p][kind]:
                    full.append((np.zeros(0, U), np.zeros(0, np.int64)))
                    continue
                key, back = np.unique(np.concatenate([x for x, _ in got[p][kind]]), return_inverse=True)
                c = np.bincount(back, np.concatenate([x for _, x in got[p][kind]]), len(key)).astype(np.int64)
                full.append((key, c))
            del got[p]
            every = np.concatenate((_word_key(full[0][0]), _pair_key(full[1][0], p)))
            bloom = segment(every, np.concatenate((level(full[0][1]), level(full[1][1]))))
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "words": [len(full[0][0])], "tokens": [int(full[0][1].sum())], "keys": pa.array([full[0][0].astype("<u8").tobytes()], pa.binary()), "counts": pa.array([full[0][1].astype("<u8").tobytes()], pa.binary()), "bloom": pa.array([bloom], pa.binary())})

    sent = training.select("text").mapInArrow(count, "part int, kind int, blob binary")
    return sent.repartitionById(parts, "part").mapInArrow(meet, "part int, words long, tokens long, keys binary, counts binary, bloom binary")


def _word_key(key: np.ndarray) -> np.ndarray:
    return mix(key ^ U(0x77))


def _pair_key(short: np.ndarray, part: int | np.ndarray) -> np.ndarray:
    return mix((short & U(0xFFFFFFFFFF)) ^ U(0x5000000000000000) ^ (np.asarray(part).astype(U) << U(40)))


def _key(hashed: np.ndarray, part: int | np.ndarray, parts: int, pair: bool) -> np.ndarray:
    return _pair_key(hashed // U(parts), part) if pair else _word_key(hashed)


def log10_probability(word: np.ndarray, pair: np.ndarray, off: np.ndarray, ends: int, total: int, distinct: int) -> np.ndarray:
    """The score of each text, from the levels of its tokens and of its pairs. ends: training texts."""
    c = MIDDLE[word]
    c[off[1:] - 1] = ends
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[off[:-1]] = ends
    p = (MIDDLE[pair] + MU * (c + 1) / (total + distinct + 1)) / (np.maximum(before, MIDDLE[pair]) + MU)
    return np.add.reduceat(np.log10(p), off[:-1]) if len(off) > 1 else np.zeros(0)


def score(docs: DataFrame, training: DataFrame, most_bytes: int = MOST_BYTES, parts: int | None = None) -> DataFrame:
    """docs: doc_id, text, uid long (a hash of the row's values). Adds n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    parts = parts or partitions(spark)
    counted = keep(gather(training, parts), "counts")
    ends = training.count()
    sums = counted.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.octet_length("bloom")), F.lit(0))).first()
    distinct, total = int(sums[0]) + (ends > 0), int(sums[1]) + ends
    if sums[2] <= most_bytes:
        rows = counted.select("part", "bloom").collect()  # at most most_bytes
        held = spark.sparkContext.broadcast(Filter(parts, [(r.part, bytes(r.bloom)) for r in rows]))

        def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 2):
                token, off = tokens(batch.column(2))
                word, pair = held.value.found(token, False), held.value.found(pairs(token, off), True)
                got = log10_probability(word, pair, off, ends, total, distinct)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(off)), pa.array(got)], names=["doc_id", "uid", "n_tokens", "score"])

        scored = docs.select("doc_id", "uid", "text").mapInArrow(at_once, "doc_id long, uid long, n_tokens long, score double")
    else:
        scored = _routed(docs, counted, ends, total, distinct, parts)
    base = _base(docs, counted, total, distinct, ends, parts)
    met = scored.join(base.withColumnRenamed("uid", "base_uid"), F.col("uid") == F.col("base_uid"), "left")
    times = F.greatest(F.col("rows"), F.lit(1))
    least = F.col("n_tokens") * F.lit(float(-np.log10(total + distinct + 1)))
    logs = F.coalesce(F.col("logs") / times, F.lit(0.0)) + F.lit(float(np.log10(ends + 1)))
    known = F.coalesce((F.col("known") / times).cast("long"), F.lit(0).cast("long")) + F.lit(int(ends > 0))
    return met.select("doc_id", "uid", "n_tokens", known.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (logs + least).alias("base_score"), "score")


def _asked(column: pa.Array, parts: int) -> tuple:
    """tokens and offsets of a batch's texts; for words and for pairs the distinct hashes, ordered by part, the part bounds
    in them, and for each token the place of its own."""
    token, off = tokens(column)
    out = [token, off]
    for hashed in (token, pairs(token, off)):
        once, back = np.unique(hashed, return_inverse=True)
        part = (once % U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        out += [once[order], np.searchsorted(part[order], np.arange(parts + 1)), place[back]]
    return tuple(out)


def _routed(docs: DataFrame, counted: DataFrame, ends: int, total: int, distinct: int, parts: int) -> DataFrame:
    """doc_id, uid, n_tokens, score, by a filter that stays in its parts. Batches of about 4 MB of texts go, compressed,
    to a task of their own; their distinct n-grams go to the parts (one row a batch and part, however often an n-gram
    occurs), and a byte for each comes back. Everything travels in shuffles that spill."""
    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("text", pa.string())])
    told = "part int, kind int, batch long, of int, blob binary"
    names = ["part", "kind", "batch", "of", "blob"]

    def rows(got: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], k) for i, k in enumerate(kinds)], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(sliced(batches, 2)):
            name = task << 32 | number
            sink = pa.BufferOutputStream()
            plain = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema)
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_batch(plain)
            got = [(name % parts, 0, name, -1, sink.getvalue().to_pybytes())]
            _, _, word, word_at, _, pair, pair_at, _ = _asked(batch.column(2), parts)
            for p in range(parts):
                w, q = word[word_at[p] : word_at[p + 1]], pair[pair_at[p] : pair_at[p + 1]]
                if len(w) + len(q):
                    got.append((p, 1, name, p, np.array([len(w)], "<u4").tobytes() + w.astype("<u8").tobytes() + _pack(q // U(parts), _WIDTH[1])))
            yield rows(got)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, np.ndarray] = {}  # rows come by part, the part's segment first
        for batch in batches:
            got = []
            for p, kind, name, of, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == 2:
                    segments = {p: np.frombuffer(blob, np.uint8)}
                elif kind == 0:
                    got.append((p, 0, name, of, blob))
                else:
                    bits = segments.get(p, np.zeros(0, np.uint8))
                    n = int(np.frombuffer(blob, "<u4", 1)[0])
                    word = np.frombuffer(blob, "<u8", n, 4).astype(U)
                    short = _unpack(blob[4 + 8 * n :], (len(blob) - 4 - 8 * n) // _WIDTH[1], _WIDTH[1])
                    key = np.concatenate((_word_key(word), _pair_key(short, p)))
                    level_ = probe(key, bits, np.zeros(len(key), np.int64), np.full(len(key), 8 * len(bits), U))
                    got.append((name % parts, 1, name, of, level_.astype(np.uint8).tobytes()))
            if got:
                yield rows(got)

    def gather_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blob, answers = None, None, {}

        def end() -> pa.RecordBatch:
            (texts,) = pa.ipc.open_stream(blob).read_all().to_batches()
            _, off, word, word_at, word_of, pair, pair_at, pair_of = _asked(texts.column(2), parts)
            levels = np.zeros(len(word), np.int64), np.zeros(len(pair), np.int64)
            for p, raw in answers.items():
                got = np.frombuffer(raw, np.uint8)
                n = word_at[p + 1] - word_at[p]
                levels[0][word_at[p] : word_at[p + 1]], levels[1][pair_at[p] : pair_at[p + 1]] = got[:n], got[n:]
            score = log10_probability(levels[0][word_of], levels[1][pair_of], off, ends, total, distinct)
            return pa.RecordBatch.from_arrays([texts.column(0), texts.column(1), pa.array(np.diff(off)), pa.array(score)], names=["doc_id", "uid", "n_tokens", "score"])

        for batch in batches:
            for _, kind, name, of, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if name != now:
                    if now is not None:
                        yield end()
                    now, blob, answers = name, None, {}
                if kind == 0:
                    blob = raw
                else:
                    answers[of] = raw
        if now is not None:
            yield end()

    asked = docs.select("doc_id", "uid", "text").mapInArrow(ask, told)
    segments = counted.select("part", F.lit(2).alias("kind"), F.lit(-1).cast("long").alias("batch"), F.lit(-1).alias("of"), F.col("bloom").alias("blob"))
    met = asked.union(segments).repartitionById(parts, "part").sortWithinPartitions("part", "batch", "kind")
    back = met.mapInArrow(answer, told).repartitionById(parts, "part").sortWithinPartitions("batch", "kind")
    return back.mapInArrow(gather_up, "doc_id long, uid long, n_tokens long, score double")


def _base(docs: DataFrame, counted: DataFrame, total: int, distinct: int, ends: int, parts: int) -> DataFrame:
    """uid, logs: the sum of log10(c + 1) over its rows' words; known: words with c > 0; rows."""
    spark = docs.sparkSession
    least = total // FREQUENT + 1

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, c = np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<u8")
                yield pa.RecordBatch.from_arrays([pa.array(k[c >= least].astype(np.int64)), pa.array(c[c >= least].astype(np.int64))], names=["key", "count"])

    often = counted.select("keys", "counts").mapInArrow(pick, "key long, count long").collect()  # at most FREQUENT rows
    key = np.array([r[0] for r in often], np.int64).astype(U)
    order = np.argsort(key)
    held = spark.sparkContext.broadcast((key[order], np.array([r[1] for r in often], np.int64)[order] if often else np.zeros(0, np.int64)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = held.value
        for batch in sliced(batches, 1):
            hashed, off = words(batch.column(1))
            uid = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(uid)), np.diff(off))
            at = np.minimum(np.searchsorted(known, hashed), max(0, len(known) - 1))
            hit = known[at] == hashed if len(known) else np.zeros(len(hashed), bool)
            logs = np.bincount(doc[hit], np.log10(count[at[hit]] + 1.0), len(uid)) if len(known) else np.zeros(len(uid))
            n = np.bincount(doc[hit], minlength=len(uid))
            ids, kinds, blobs = [], [], []
            to = (uid.astype(U) % U(parts)).astype(np.int64)
            for p in np.unique(to):  # what is known here goes straight to the text's own part
                own = to == p
                blobs.append(_told(uid[own], logs[own], n[own], np.ones(own.sum(), np.int64)))
                ids.append(p)
                kinds.append(0)
            rare, doc = hashed[~hit], doc[~hit]
            part = (rare % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rare, doc, part = rare[order], doc[order], part[order]
            bound = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(bound)):
                d, each = np.unique(doc[bound[p] : bound[p + 1]], return_counts=True)
                own = rare[bound[p] : bound[p + 1]] // U(parts)
                blobs.append(np.array([len(own), len(d)], "<u4").tobytes() + uid[d].astype("<i8").tobytes() + each.astype("<u4").tobytes() + _pack(own, 7))
                ids.append(p)
                kinds.append(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, tuple] = {}
        waiting: dict[int, list[bytes]] = {}

        def answer(p: int, blobs: list[bytes]) -> pa.RecordBatch:
            """What the part knows of its texts, one row for each part that texts belong to."""
            keys, counts = tables.pop(p, (np.zeros(0, U), np.zeros(0, np.int64)))
            every = []
            while blobs:
                blob = blobs.pop()
                n, d = np.frombuffer(blob, "<u4", 2)
                uid, each = np.frombuffer(blob, "<i8", d, 8), np.frombuffer(blob, "<u4", d, 8 + 8 * d)
                key = _unpack(blob[8 + 12 * d :], n, 7)
                at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                c = np.where(keys[at] == key, counts[at], 0) if len(keys) else np.zeros(n, np.int64)
                first = np.concatenate(([0], np.cumsum(each.astype(np.int64))[:-1]))
                logs, known = np.add.reduceat(np.log10(c + 1.0), first), np.add.reduceat((c > 0).astype(np.int64), first)
                some = known > 0
                every.append(np.frombuffer(_told(uid[some], logs[some], known[some], np.zeros(some.sum(), np.int64)), _TOLD))
            told = np.concatenate(every)
            to = (told["uid"].astype(U) % U(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            bound = np.searchsorted(to[order], np.arange(parts + 1))
            ids = np.flatnonzero(np.diff(bound))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([told[order[bound[q] : bound[q + 1]]].tobytes() for q in ids], pa.binary())], names=["part", "blob"])

        for batch in batches:
            for p, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])
                elif kind == 2:
                    n = len(blob) // 16
                    keys = np.frombuffer(blob, "<u8", n) // U(parts) & U((1 << 56) - 1)
                    order = np.argsort(keys)
                    tables[p] = keys[order], np.frombuffer(blob, "<u8", n, 8 * n).astype(np.int64)[order]
                else:
                    waiting.setdefault(p, []).append(blob)
        for p, blobs in waiting.items():
            yield answer(p, blobs)

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.frombuffer(x, _TOLD) for batch in batches for x in batch.column(1).to_pylist()]
        if not got:
            return
        every = np.concatenate(got)
        uid, back = np.unique(every["uid"], return_inverse=True)
        cols = [np.bincount(back, every[k], len(uid)) for k in ("logs", "known", "rows")]
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(cols[0]), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.int64))], names=["uid", "logs", "known", "rows"])

    tables = counted.select("part", F.lit(2).alias("kind"), F.concat("keys", "counts").alias("blob"))
    sent = docs.select("uid", "text").mapInArrow(send, "part int, kind int, blob binary")
    answered = sent.union(tables).repartitionById(parts, "part").mapInArrow(look, "part int, blob binary")
    return answered.repartitionById(parts, "part").mapInArrow(total_up, "uid long, logs double, known long, rows long")


_TOLD = np.dtype([("uid", "<i8"), ("logs", "<f8"), ("known", "<u4"), ("rows", "<u4")])


def _told(uid: np.ndarray, logs: np.ndarray, known: np.ndarray, rows: np.ndarray) -> bytes:
    out = np.empty(len(uid), _TOLD)
    out["uid"], out["logs"], out["known"], out["rows"] = uid, logs, known, rows
    return out.tobytes()


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("uid"))
    out = score(docs, docs.where(remainder(F.col("doc_id"), 7) != 2).select("text"))
    return out.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
