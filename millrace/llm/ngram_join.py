"""Similarity self-join on word shingles by parity sketches.

A document is the set of its distinct 5-word shingles, each a 64-bit hash. Every shingle toggles one bit of a sketch,
so the Hamming distance of two sketches never exceeds the symmetric difference of the sets. Documents fall into size
bands (each 1.25 times the last); in a band the sketch is cut into more words than two similar sets can differ in
shingles, so by the pigeonhole principle similar sets agree in some words. A word's key is the XOR of the hashes of
the bits that are set in it.

1. Equal sets collapse: one node per distinct set, whatever the number of copies.
2. Nodes meet by equal keys. The keys of many documents travel in packed blobs, by range of the key.
3. Of the nodes that share a key, each is verified against one, the node with the most agreement overall. The links
   found make components; most groups of near copies are one component now.
4. Only where the nodes of a key are still in several components are other pairs tried: across components, in blocks,
   those whose sizes and longer sketches allow a link. These are verified too, so no link is lost.
5. Components of all links are the result.

Verification takes whole sets, recomputed from whole texts. With slack s in the number of words, two similar sets agree
in more than s words; a set with at most s empty words therefore agrees in one that is not empty, and only sets with
more empty words also give keys for these.

Hot keys: a key of more than BLOCK nodes is cut into blocks, and each pair of its blocks is a group of its own, so no task
takes a whole key; only pairs that sizes and sketches allow leave it.

Defined cases: null text or text without words is linked with nothing (size 0, its own component); fewer words than
five are one shingle; very long texts are hashed in pieces; rows that repeat a doc_id each come back, and all their texts
belong to one document, so they are linked with one another; a row with a null doc_id takes part like others, but lends
no id: its component_id is the smallest id that it reaches, null where there is none; an empty table gives no rows;
columns beyond doc_id and text are left alone. Nodes are told apart by 64-bit digests of their shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import components, documents, keep, mix, partitions, sliced, words

#: Links: 100 * intersection >= LEAST * union.
LEAST = 80
SHINGLE = 5
#: Longs in the bitmap of the ids of documents that are needed again.
BITMAP = 1 << 16
#: Nodes of a key that are compared in one group, and nodes that a task remembers.
BLOCK, SEEN = 4096, 1 << 20
U = np.uint64
_EMPTY = U(0x5A17_0F3C_9E2B_4D61)


def sets(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, in one array, and its offsets."""
    hashed, off = words(column)
    n = np.diff(off)
    runs = []
    if len(hashed) >= width:
        grams = np.zeros(len(hashed) - width + 1, U)
        for k in range(width):
            grams = grams * U(0x9FB21C651E98DF25) + hashed[k : len(hashed) - width + 1 + k]
        grams = mix(grams + U(width))
    for i in range(len(n)):
        if n[i] >= width:
            own = np.sort(grams[off[i] : off[i + 1] - width + 1])
            runs.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif n[i]:
            h = int(n[i])
            for x in hashed[off[i] : off[i + 1]].tolist():
                h = (h * 0x9FB21C651E98DF25 + x) % (1 << 64)
            runs.append(mix(np.array([h], U)))
        else:
            runs.append(np.zeros(0, U))
    sizes = np.array([len(r) for r in runs], np.int64)
    return (np.concatenate(runs) if runs else np.zeros(0, U)), np.concatenate(([0], np.cumsum(sizes)))


def digests(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    out = np.zeros(len(off) - 1, U)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        xor, add = np.bitwise_xor.reduceat(grams, off[full]), np.add.reduceat(mix(grams), off[full])
        out[full] = mix(xor ^ mix(add + np.diff(off)[full].astype(U)))
    return out


def bands(largest: int, least: int = LEAST) -> np.ndarray:
    """Least sizes of the bands: two sets of sizes that can link are in one band or in neighbours."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // least)))
    return np.array(edges, np.int64)


def layout(low: np.ndarray, high: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Of bands with sizes low to high - 1: the number of words of their sketches, and the slack in it.

    The smaller set of a pair has at most high - 1 shingles, so the sets differ in at most (100 - least) / (100 + least)
    of (high - 1) * (1 + 100 / least) shingles."""
    most = (high - 1) * (100 - least) // least
    words_ = most + 1.0
    slack = np.zeros(len(low))
    for _ in range(8):
        empty = words_ * np.exp(-low / words_)
        slack = np.ceil(empty + 2.5 * np.sqrt(empty) + 0.5)
        words_ = most + 1 + slack
    return words_.astype(np.int64), slack.astype(np.int64)


def keys(grams: np.ndarray, off: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each set and their offsets: of its own band, and, as the larger of a pair, of the band below.
    A set for which no other can link (bands where none may differ) has none."""
    n = np.diff(off)
    band = np.searchsorted(edges, n, "right") - 1
    got, whose = [], []
    for down in (0, 1):
        g = band - down
        at = np.flatnonzero((n > 0) & (g >= 0))
        if not len(at):
            continue
        low, high = edges[g[at]], edges[g[at] + 1]
        at, g, low, high = (x[(high - 1) * (100 - LEAST) // LEAST > 0] for x in (at, g[at], low, high))
        if not len(at):
            continue
        count, slack = layout(low, high)
        base = np.concatenate(([0], np.cumsum(count)))
        each = n[at]
        own = np.concatenate([grams[off[i] : off[i + 1]] for i in at])
        slot = np.repeat(base[:-1], each) + (mix(own ^ U(0x1234567)) % np.repeat(count, each).astype(U)).astype(np.int64)
        word = np.zeros(base[-1], U)
        np.bitwise_xor.at(word, slot, own)
        empty = np.bincount(slot, minlength=base[-1]) == 0
        word[empty] = _EMPTY
        number = np.arange(base[-1]) - np.repeat(base[:-1], count)
        name = np.repeat(g, count).astype(U) << U(40)
        key = mix(word ^ mix(name + number.astype(U)))
        many = np.add.reduceat(empty, base[:-1]) > slack
        take = ~empty | np.repeat(many, count)
        got.append(key[take])
        whose.append(np.repeat(at, count)[take])
    if not got:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    key, doc = np.concatenate(got), np.concatenate(whose)
    order = np.argsort(doc, kind="stable")
    return key[order], np.searchsorted(doc[order], np.arange(len(off)))


def sketch(grams: np.ndarray) -> bytes:
    """A set's parity sketch: at least two bits a shingle, 64 at least; sizes of one band give lengths that fold."""
    bits = max(64, 1 << int(len(grams) * 2 - 1).bit_length())
    on = np.bincount((mix(grams ^ U(0x7654321)) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(on.astype(np.uint8)).tobytes()


def _unblob(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, d = np.frombuffer(raw, "<u4", 2)
    node = np.frombuffer(raw, "<u8", d, 8)
    count = np.frombuffer(raw, "<u4", d, 8 + 8 * d)
    return np.frombuffer(raw, "<u4", m, 8 + 12 * d), count, node


def shared_keys(docs: DataFrame, parts: int) -> DataFrame:
    """(key, node, weight): the nodes of each key that more than one node has; where the same nodes share several keys
    of a part of the key space, they come once, weight the number of those keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes of this task: copies give their keys once
        for batch in sliced(batches, 0):
            grams, off = sets(batch.column(0))
            node = digests(grams, off)
            fresh = []
            if len(seen) > SEEN:  # what comes again then is sorted out where keys meet
                seen.clear()
            for i, x in enumerate(node.tolist()):
                if off[i + 1] > off[i] and x not in seen:
                    seen.add(x)
                    fresh.append(i)
            if not fresh:
                continue
            own = np.concatenate([grams[off[i] : off[i + 1]] for i in fresh])
            own_off = np.concatenate(([0], np.cumsum(np.diff(off)[fresh])))
            key, key_off = keys(own, own_off, bands(int(np.diff(own_off).max())))
            if not len(key):
                continue
            doc = np.repeat(np.arange(len(fresh)), np.diff(key_off))
            part = ((key & U(0xFFFFFFFF)) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, doc, high = part[order], doc[order], (key[order] >> U(32)).astype("<u4")
            bound = np.searchsorted(part, np.arange(parts + 1))
            ids, blobs = [], []
            for p in np.flatnonzero(np.diff(bound)):
                a, b = bound[p], bound[p + 1]
                d, count = np.unique(doc[a:b], return_counts=True)
                blobs.append(np.array([b - a, len(d)], "<u4").tobytes() + node[[fresh[x] for x in d]].astype("<u8").tobytes() + count.astype("<u4").tobytes() + high[a:b].tobytes())
                ids.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_part.setdefault(p, []).append(_unblob(blob))
        for p in sorted(by_part):
            got = by_part.pop(p)
            key = np.concatenate([x[0] for x in got])
            node = np.concatenate([np.repeat(x[2], x[1]) for x in got])
            del got
            order = np.argsort(key, kind="stable")
            key, node = key[order], node[order]
            again = key[1:] == key[:-1]
            inside = np.zeros(len(key), bool)
            inside[1:] |= again
            inside[:-1] |= again
            key, node = key[inside], node[inside]
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            end = np.append(begin[1:], len(key))
            two = end - begin > 1
            begin, end = begin[two], end[two]
            if not len(begin):
                continue
            alike = mix(np.array([int(np.bitwise_xor.reduce(mix(node[a:b]))) ^ (int(b - a) << 1) for a, b in zip(begin, end, strict=True)], U))
            _, first, times = np.unique(alike, return_index=True, return_counts=True)
            for lo in range(0, len(first), 4096):
                take, n = first[lo : lo + 4096], times[lo : lo + 4096]
                size = (end - begin)[take]
                at = np.concatenate([np.arange(begin[t], end[t]) for t in take])
                name = np.repeat((key[begin[take]].astype(U) << U(31)) ^ mix(np.full(len(take), p, U)), size)
                yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int64)), pa.array(node[at].astype(np.int64)), pa.array(np.repeat(n, size).astype(np.int64)), pa.array(np.repeat(size, size).astype(np.int64))], names=["key", "node", "weight", "size"])

    blobs = docs.select("text").mapInArrow(emit, "part int, blob binary")
    return blobs.repartitionById(parts, "part").mapInArrow(meet, "key long, node long, weight long, size long")


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, uid, node, n_shingles, sketch of docs (doc_id, uid, text)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            grams, off = sets(batch.column(2))
            full = pa.array([sketch(grams[a:b]) if b > a else b"" for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests(grams, off).astype(np.int64)), pa.array(np.diff(off)), full], names=["doc_id", "uid", "node", "n_shingles", "sketch"])

    return docs.select("doc_id", "uid", "text").mapInArrow(digest, "doc_id long, uid long, node long, n_shingles long, sketch binary")


def _whole(docs: DataFrame) -> DataFrame:
    """node, n, shingles (sorted) of each document of docs (text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat give their set once a task
        for batch in sliced(batches, 0):
            grams, off = sets(batch.column(0))
            node = digests(grams, off).astype(np.int64)
            if len(seen) > SEEN:
                seen.clear()
            new = np.array([i for i, x in enumerate(node.tolist()) if not (x in seen or seen.add(x))], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(grams.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node[new]), pa.array(np.diff(off)[new]), lists.take(pa.array(new))], names=["node", "n", "shingles"])

    return docs.select("text").mapInArrow(make, "node long, n long, shingles array<long>")


def _near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of nodes whose sizes and sketches allow a link."""

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in (2, 3))
            fits = 100 * np.minimum(na, nb) >= LEAST * np.maximum(na, nb)
            xs, ys = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for i in np.flatnonzero(fits):
                to = min(len(xs[i]), len(ys[i]))
                apart = int(np.bitwise_count(np.bitwise_xor(*_fold([xs[i], ys[i]], to))).sum())
                fits[i] = (100 + LEAST) * apart <= (100 - LEAST) * (na[i] + nb[i])
            took = pa.array(np.flatnonzero(fits))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took)], names=["a", "b"])

    left = reps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("xa"))
    right = reps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("xb"))
    met = pairs.join(right, "b").join(left, "a")
    return met.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(allowed, "a long, b long")


def _links(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of nodes that link, by their whole sets, from one document each. b may be in very many pairs,
    whose rows then stand side by side with the same set when they are moved to a, and compress to little."""
    some = pairs.select("a").union(pairs.select("b")).distinct()
    needed = reps.join(some, F.col("node") == F.col("a")).select("first_uid")
    whole = keep(_whole(among(docs, needed)), "sets")
    left = whole.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = whole.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    met = pairs.join(right, "b").join(left, "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.where(100 * both >= LEAST * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _fold(raw: list[bytes], to: int) -> np.ndarray:
    """Sketches folded by XOR to `to` bytes each: their distance still never exceeds the symmetric difference."""
    out = np.zeros((len(raw), to // 8), U)
    for i, x in enumerate(raw):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, U).reshape(-1, to // 8), axis=0)
    return out


def _across(members: DataFrame) -> DataFrame:
    """Pairs (a, b) to verify of members (key, blocks, node, label, n, sketch): of different labels under one key, whose
    sizes and sketches allow a link. The nodes of a key are dealt to its blocks (of about BLOCK) by hash, and a group is a
    block with itself or with another, so memory and time of a task are bounded by two blocks' sketches."""

    def pairs(node: np.ndarray, label: np.ndarray, n: np.ndarray, side: np.ndarray, raw: list[bytes], one: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(n, kind="stable")
        node, label, n, side, raw = node[order], label[order], n[order], side[order], [raw[i] for i in order]
        for lo in range(0, len(node), 256):
            hi = min(lo + 256, len(node))
            end = int(np.searchsorted(n * LEAST, n[hi - 1] * 100, "right"))
            block = _fold(raw[lo:end], len(raw[lo]))
            for i in range(lo, hi):
                stop = int(np.searchsorted(n * LEAST, n[i] * 100, "right"))
                if stop <= i + 1:
                    continue
                apart = np.bitwise_count(block[i - lo] ^ block[i + 1 - lo : stop - lo]).sum(axis=1, dtype=np.int64)
                ok = (label[i + 1 : stop] != label[i]) & ((100 + LEAST) * apart <= (100 - LEAST) * (n[i] + n[i + 1 : stop]))
                if not one:
                    ok &= side[i + 1 : stop] != side[i]
                hit = node[i + 1 : stop][ok]
                if len(hit):
                    yield np.minimum(node[i], hit), np.maximum(node[i], hit)

    def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                _, x, y = held[0][0]
                for a, b in pairs(*(np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4)), [r for h in held for r in h[5]], x == y):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            key, x, y, node, label, n, side = (batch.column(i).to_numpy() for i in range(7))
            raw = batch.column(7).to_pylist()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                name = (key[lo], x[lo], y[lo])
                if held and held[0][0] != name:
                    yield from flush()
                held.append((name, node[lo:hi], label[lo:hi], n[lo:hi], side[lo:hi], raw[lo:hi]))
        yield from flush()

    own = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("x"), F.greatest("block", j).alias("y")))
    each = own.select("key", F.inline(mates), "node", "label", "n", F.col("block").alias("side"), "sketch")
    dealt = each.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").select("key", "x", "y", "node", "label", "n", "side", "sketch")
    return dealt.mapInArrow(by_key, "a long, b long").distinct()


def among(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of docs whose uid is a first_uid of needed. A bitmap of the uids, of fixed size (BITMAP longs), is
    broadcast first, so that texts which aren't needed don't move; the join that follows is exact at any size."""
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(shiftright({c}, 20), 64) as int))")
    word = lambda c: F.pmod(F.col(c), F.lit(BITMAP)).cast("int")
    needed = keep(needed, "needed")
    bitmap = needed.groupBy(word("first_uid").alias("word")).agg(F.bit_or(bit("first_uid")).alias("bits"))
    some = docs.withColumn("at", word("uid")).join(F.broadcast(bitmap), F.col("at") == F.col("word")).where(F.col("bits").bitwiseAND(bit("uid")) != 0)
    return some.join(needed, F.col("uid") == F.col("first_uid"), "left_semi").select(*docs.columns)


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("uid", F.xxhash64("doc_id", "text"))
    info = keep(nodes(docs), "nodes")
    shared = keep(shared_keys(docs, partitions(spark)), "shared")
    full = info.where("n_shingles > 0")
    reps = full.groupBy("node").agg(F.min("uid").alias("first_uid"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    reps = keep(reps.join(shared.select("node").distinct(), "node", "left_semi"), "sketches")
    # the texts of one doc_id
    own = full.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    same = full.join(own, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    # each node of a key against the one that agrees most
    weight = shared.groupBy("node").agg(F.sum(F.col("weight") * (F.col("size") - 1)).alias("agreed"))
    best = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("agreed", "node"))["node"].alias("b"))
    met = keep(shared.join(best, "key").where("node <> b").select("key", F.col("node").alias("a"), "b"), "stars")
    stars = met.select("a", "b").distinct()
    near = keep(_links(keep(_near(stars, reps), "near"), docs, reps).union(same.distinct()), "links")
    label = components(near)
    # what is left of a key beside that one, where it is still in several components
    known = met.join(label, met.a == label.node, "left").select("key", F.col("a").alias("node"), F.coalesce("component", "a").alias("label"))
    mixed = known.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("x <> y").select("key", "blocks")
    members = known.join(mixed, "key").join(reps.select("node", "n", "sketch"), "node")
    more = keep(_links(keep(_across(members), "near"), docs, reps), "links")
    whose = full.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    ids = whose.join(components(near.union(more)), "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    least = ids.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = ids.join(least, "component").select("node", "component_id")
    met = info.join(found.withColumnRenamed("node", "own"), (F.col("node") == F.col("own")) & (F.col("n_shingles") > 0), "left")
    return met.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir))


def keep_dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, that with the smallest doc_id (with all rows of that id). Rows
    with a null doc_id stay, as nothing names them; an empty table stays empty. Returns docs' own columns."""
    kept = similar(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    alone = docs.where("doc_id is null")
    return docs.join(kept, docs.doc_id == kept["_kept"], "left_semi").unionByName(alone)
