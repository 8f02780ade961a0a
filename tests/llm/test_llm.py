"""Training-data operators against plain Python forms, on the fixture and on small awkward tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, fingerprints, language_id, lm_scoring, mixing, ngram_join, packing, sharding, toxicity, warc
from millrace.llm.common import components, documents, words

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in documents(spark, SMALL).collect()]


#: Over a MiB, in one line.
LONG = " ".join(f"wort{i * 7919 % 60000}" for i in range(130_000))


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Nulls, empty and long texts, ties, repeated rows, an extra column with a clashing name."""
    rng = random.Random(5)
    base = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(80))
    rows = [(1, base, "en", "a", 1), (2, base, None, None, None), (3, base + " x", "en", "b", 3), (4, None, "de", None, 0), (5, "", "de", "b", 0), (6, "a b", "en", "c", 3), (7, "A\tb", "en", "c", 3), (8, " \n", None, "c", 2), (9, LONG, "de", "d", 1), (6, "a b", "en", "c", 3), (10, "…—“”", None, "a", 4), (None, "no id", "en", "a", 5)]
    path = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1)).withColumn("uid", F.lit("u")).withColumn("own", F.lit(2)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 0, 0), (6, 1, 0), (6, 1, 1), (None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("label_id", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "http://a/x y", "<p>" + "z" * 200), (2, None, "<p>" + "z" * 200), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "x\r\n\r\nWARC/1.1\r\nä"), (6, "http://e", "x\r\n\r\nWARC/1.1\r\nä"), (2, None, "<p>" + "z" * 200)], "page_id long, url string, html string").withColumn("uid", F.lit("x")).withColumn("digest", F.lit(3)).withColumn("a.b", F.lit(1)).write.parquet(f"{path}/pages.parquet")
    empty = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{empty}/pages.parquet")
    return path, empty, rows


OPS = [fingerprints.op1_fingerprints, sharding.op2_sharding, ngram_join.op3_ngram_join, packing.op4_packing, lm_scoring.op5_lm_scoring, toxicity.op6_toxicity, exact_dedup.op7_exact_dedup, mixing.op8_mixing, warc.op9_warc, language_id.op10_language_id]


@pytest.mark.parametrize("op", OPS, ids=[f.__name__ for f in OPS])
def test_awkward_and_empty_tables(spark, awkward, op):
    path, empty, rows = awkward
    got = op(spark, path).collect()
    if op is warc.op9_warc:
        assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter([(1, "response", None, 203), (2, "revisit", 1, 203), (2, "revisit", 1, 203), (3, "response", None, 0), (4, "response", None, 0), (5, "response", None, 17), (6, "response", None, 17)])
    elif op is not packing.op4_packing:
        assert len(got) == len(rows)
    assert op(spark, empty).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


def test_words_agree_with_the_pattern():
    texts = ["", " ", "One two\tONE\nthree", "x", None, "ends ", "é É " * 3, "long" * 400_000 + " tail word", "a " * 1_500_000]
    hashed, off, first, end = words(pa.array(texts), spans=True)
    for i, t in enumerate(texts):
        want = brute.WORD.findall(brute.lower(t or ""))
        own = hashed[off[i] : off[i + 1]]
        assert len(own) == len(want)
        assert len({*own.tolist()}) == len({*want})


def test_fingerprints(spark, rows):
    out = {r.doc_id: r for r in fingerprints.op1_fingerprints(spark, SMALL).collect()}
    order = sorted(rows, reverse=True)
    for i, (d, t) in enumerate(order):
        half, following = len(t) // 2, order[(i + 1) % len(order)][1]
        assert out[d].edited_sha256 == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
        assert 0 <= out[d].near_edited <= 1 and 0 <= out[d].near_next <= 1
    prints = defaultdict(set)
    for d, t in rows:
        prints[t].add(out[d].fingerprint)
    assert max(map(len, prints.values())) == 1
    assert all(r.near_edited > r.near_next for r in out.values() if r.n_chars >= 500)
    assert all(r.near_edited > 0 for r in out.values() if len(dict(rows)[r.doc_id].split()) >= 4)


def _decoded(told):
    """The digests that a returned fingerprint gives away, peeled in plain Python; None where that fails."""
    w, n, rest = told.split(":")
    signed = lambda x: int(x, 16) - (1 << 64) * (int(x, 16) >> 63)
    cells = {int(j): [int(c), signed(k), int(h, 16)] for j, c, k, h in (x.split(".") for x in rest.split(",") if x)}
    found = set()
    while True:
        pure = {x[1] for x in cells.values() if x[0] == 1}
        if not pure:
            return found if not any(x[0] or x[1] or x[2] for x in cells.values()) and len(found) == int(n) else None
        for k in pure:
            found.add(k)
            mine = [(j, x) for j, x in cells.items() if x[1] == k and x[0] == 1]
            e, h = _xx(k), _xx(k, 1) % (1 << 64) >> 32
            for t in range(3):
                x = cells[(e % (1 << 64) >> (20 * t) & int(w) - 1) * 3 + t]
                x[0], x[1], x[2] = x[0] - 1, x[1] ^ k, x[2] ^ h
            if not mine:
                return None


def _xx(*longs):
    """xxhash64 of longs as Spark chains it, from seed 42."""
    import struct

    import xxhash

    seed = 42
    for x in longs:  # ints are hashed as 4 bytes
        raw = struct.pack("<q", x) if abs(x) > 1 << 31 else struct.pack("<i", x) if x == 1 else struct.pack("<q", x)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) * (seed >> 63)


def test_likeness_is_the_set_difference_and_follows_from_the_fingerprints(spark, sf_dir):
    """Against plain sets, for every document, and again from the returned columns alone."""
    import regex

    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)

    def pieces(t):
        cut = regex.findall(r"[^\n][^\n.!?]{0,239}[.!?]*", t)
        return {x.strip(" ") for x in cut} | ({("word", w) for w in regex.findall(r"[^ \t\n\x0b\f\r]+", t)} if len(cut) < 8 else set())

    like = lambda a, b: 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0
    for i, (d, t) in enumerate(rows):
        half, following = len(t) // 2, rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - half] + following[:half]
        assert abs(out[d].near_edited - like(pieces(t), pieces(edited))) < 1e-12, d
        assert abs(out[d].near_next - like(pieces(t), pieces(following))) < 1e-12, d
    read = {d: (_decoded(r.fingerprint), _decoded(r.edited_fingerprint)) for d, r in out.items()}
    whole = sum(None not in x for x in read.values())
    assert whole >= 0.99 * len(rows)
    for i, (d, _) in enumerate(rows):
        own, edited = read[d]
        following = read[rows[(i + 1) % len(rows)][0]][0]
        if own is not None and edited is not None and following is not None:
            assert abs(out[d].near_edited - like(own, edited)) < 1e-12 and abs(out[d].near_next - like(own, following)) < 1e-12


def test_fingerprints_of_short_sentences(spark):
    docs = spark.createDataFrame([(2, "Aa bb cc. Dd ee ff. Gg hh ii. Jj kk ll."), (1, "Xx yy zz. Uu vv ww. Pp qq rr.")], "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    # the edited text has the first two sentences of four, six words of twelve, and as many others
    assert out[2].near_edited == 0.5 and out[2].near_next == 0


def test_peeling_recovers_the_difference(spark):
    a, b = list(range(1, 300)), list(range(111, 450))
    digests = lambda xs: f"transform(array({','.join(f'{x}L' for x in xs)}), d -> xxhash64(d))"
    diff = fingerprints.combine(f"concat({fingerprints.entries(digests(a), '256L')}, {fingerprints.entries(digests(b), '256L', -1)})")
    got = spark.range(1).select(F.expr(fingerprints.peel(diff, "256L")).alias("r"), F.expr(digests(sorted(set(a) ^ set(b)))).alias("want")).first()
    assert got.r.whole and sorted(x.k for x in got.r.found) == sorted(got.want)
    assert sum(x.c for x in got.r.found) == len(a) - len(b)


def test_fingerprints_retry_larger(spark):
    """A short text next to a long one: the short one's width can't hold the difference."""
    long = " ".join(f"Sentence number {i} of them." for i in range(3000))
    docs = spark.createDataFrame([(3, "One. " * 30 + "Two."), (2, long), (1, long.replace("number 7 ", "number seven "))], "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    assert out[3].near_next == 0 and out[3].near_next_tries >= 2
    assert out[2].near_next == 1 - 2 / 6000 and out[2].near_next_tries == 1


def test_sharding(spark, rows):
    out = sharding.op2_sharding(spark, "/root/testdata/sf0.01").collect()
    counts, slots = Counter(r.shard for r in out), defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keys = sharding.sized(documents(spark, "/root/testdata/sf0.01"))
    grown = {r.doc_id: r.shard for r in sharding.shard(keys, 25).collect()}
    moved = sum(grown[r.doc_id] != r.shard for r in out)
    assert moved < 0.35 * len(out)  # a plain hash modulo the count moves 96 %


def test_ngram_join(spark, sf_dir):
    docs = documents(spark, sf_dir)
    want = brute.jaccard_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op3_ngram_join(spark, sf_dir).collect()} == want


def test_ngram_join_of_star_and_threshold(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # each near the base, hardly near each other
        own = list(base)
        for k in rng.sample(range(150), 2):
            own[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + n, " ".join(f"t{j}" for j in range(n))) for n in range(0, 40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard_components(rows)


def test_ngram_join_of_repeated_and_null_ids(spark):
    rng = random.Random(9)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    a, b, c = text(), text(), text()
    near = lambda t: " ".join([*t, "more"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, near(a)), (7, " ".join(b)), (None, near(c)), (9, " ".join(c)), (None, "quite alone here with no other text"), (None, None), (5, ""), (8, None)]
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # 7 reaches 3 through document 5, which has both texts; a row without an id lends none
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter([(5, 56, 3), (5, 56, 3), (3, 57, 3), (7, 56, 3), (None, 57, 9), (9, 56, 9), (None, 3, None), (None, 0, None), (5, 0, 5), (8, 0, 8)])


def test_ngram_join_of_one_hot_key(spark):
    """Nodes that share a key, most of which don't link, in blocks: no link between them is lost."""
    rng = np.random.default_rng(4)
    n, size = 10_000, 40
    grams = rng.integers(0, 1 << 62, (n, size)).astype(np.uint64)
    twins = rng.choice(n // 2, 300, replace=False)
    grams[twins + n // 2, :-2] = grams[twins, :-2]
    raw = [ngram_join.sketch(np.unique(g)) for g in grams]
    members = spark.createDataFrame([(1, i, i, size, r) for i, r in enumerate(raw)], "key long, node long, label long, n long, sketch binary").withColumn("blocks", F.lit(20))
    got = {(r.a, r.b) for r in ngram_join._across(members).collect()}
    assert {(int(t), int(t) + n // 2) for t in twins} <= got and len(got) < 2 * len(twins)


def test_packing_round_trip(spark, rows):
    ids, by, sequences = packing.Ids(), defaultdict(list), defaultdict(list)
    for r in packing.op4_packing(spark, SMALL).collect():
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, t in rows:
        want = np.append(np.array(ids.slow.encode(t, add_special_tokens=False).ids, np.uint32), np.uint32(0)).astype("<u4")
        at = 0
        for p in sorted(by[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(want), zlib.crc32(want[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(want)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0


def test_both_tokenizers_agree_on_plain_characters():
    ids = packing.Ids()
    for cp in [*range(1, packing.PLAIN + 64), 0x2028, 0x3000, 0xE000]:
        c = chr(cp)
        t = f"a{c}b {c} {c}{c}1{c}!{c}'s  {c}\n{c}x"
        assert ids(t).tolist() == ids.slow.encode(t, add_special_tokens=False).ids, hex(cp)
    assert ids("a<|endoftext|>b").tolist() == ids.slow.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_hilbert_is_a_curve():
    bits, dims = 3, 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims).astype(np.uint64)
    key = packing.hilbert(grid, bits)
    order = grid[np.argsort(key)].astype(int)
    assert sorted(key.tolist()) == list(range(1 << bits * dims))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_lm_scoring(spark, rows):
    import math

    tokens = {d: [*brute.WORD.findall(brute.lower(t)), None] for d, t in rows}
    count = Counter(x for d, ts in tokens.items() if brute.crc(d) % 7 != 2 for x in ts)
    n, v = sum(count.values()), len(count)
    for r in lm_scoring.op5_lm_scoring(spark, SMALL).collect():
        ts = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ts), sum(count[x] > 0 for x in ts), n, brute.crc(r.doc_id) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in ts), rel_tol=1e-9)
        assert r.score < 0
    docs = documents(spark, SMALL).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    once, routed = ({r.doc_id: r.score for r in lm_scoring.score(docs, docs, most_bytes=b).collect()} for b in (1 << 28, 1000))
    assert len(once) == len(rows) and once == routed


def test_lm_scoring_against_a_plain_model(spark, rows):
    """Quantised counts and smoothing in plain Python: probes of the filter err for few n-grams only."""
    import math

    tokens = {d: [None, *brute.WORD.findall(brute.lower(t)), None] for d, t in rows}
    training = [d for d in tokens if brute.crc(d) % 7 != 2]
    one, two = Counter(x for d in training for x in tokens[d][1:]), Counter(x for d in training for x in zip(tokens[d][:-1], tokens[d][1:], strict=True))
    n, v, mu = sum(one.values()), len(one), lm_scoring.MU
    about = lambda c: float(lm_scoring.MIDDLE[lm_scoring.level(np.array([c]))[0]])
    c1 = lambda x: len(training) if x is None else about(one[x])

    def plain(t):
        return sum(math.log10((about(two[a, b]) + mu * (c1(b) + 1) / (n + v + 1)) / (max(c1(a), about(two[a, b])) + mu)) for a, b in zip(t[:-1], t[1:], strict=True))

    out = {r.doc_id: r.score for r in lm_scoring.op5_lm_scoring(spark, SMALL).collect()}
    off = [abs(out[d] / len(t) - plain(t) / len(t)) for d, t in tokens.items()]
    assert max(off) < 0.15 and sum(off) / len(off) < 0.02
    # keys that were never put in: few are found
    rng = np.random.default_rng(3)
    raw = lm_scoring.segment(rng.integers(0, 1 << 62, 50_000).astype(np.uint64), np.ones(50_000, np.int64))
    other = rng.integers(1 << 62, 1 << 63, 100_000).astype(np.uint64)
    level = lm_scoring.probe(other, np.frombuffer(raw, np.uint8), np.zeros(len(other), np.int64), np.full(len(other), 8 * len(raw), np.uint64))
    assert (level > 0).mean() < 0.012


def test_lm_scoring_knows_pairs_seen_once(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "z w"), (3, "z y")], "doc_id long, text string").withColumn("uid", F.xxhash64("doc_id"))
    out = {r.doc_id: r.score for r in lm_scoring.score(docs, docs.where("doc_id < 3").select("text")).collect()}
    # both end in y; x y was seen once, z y never: p(y) = (1 + 1) / (6 + 5 + 1)
    back = lm_scoring.MU * 2 / 12
    assert abs(out[1] - out[3] - np.log10((1 + back) / back)) < 1e-9


def test_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    every = toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert all(len(r.evidence) == 3 for r in every)
    out = [r for r in every if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in out) >= 0.97 * len(out)
    # calibration: far below the Brier score of the share of toxic rows, and bins near the share that they tell
    base = sum(labels[r.doc_id] for r in out) / len(out)
    assert sum((r.score - labels[r.doc_id]) ** 2 for r in out) / len(out) < 0.35 * base * (1 - base)
    low = [r for r in out if r.score < 0.5]
    assert abs(sum(r.score for r in low) - sum(labels[r.doc_id] for r in low)) < 0.05 * len(low)


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(500):
        place = rng.choice(40, rng.integers(1, 6), replace=False)
        w = rng.random(len(place))
        rows.append((i, int(i % 2), dict(zip(place.tolist(), (w / np.linalg.norm(w)).tolist(), strict=True))))
    index = toxicity.Index(np.arange(40, dtype=np.uint64), np.ones(40), rows, (1.0, 1.0), 0.1)
    dense = np.zeros((len(rows), 40))
    for d, _, w in rows:
        dense[d, list(w)] = list(w.values())
    for _ in range(50):
        place = np.sort(rng.choice(40, 4, replace=False))
        w = rng.random(4)
        w /= np.linalg.norm(w)
        got, cosine = index.nearest(place, w)
        want = np.sort(dense[:, place] @ w)[::-1][: toxicity.NEAREST]
        assert np.allclose(cosine, want[want > 0])


def test_nearest_is_exact_with_common_and_rare_terms():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(500):
        place = np.unique(np.concatenate((rng.choice(5, 3), rng.choice(np.arange(5, 300), rng.integers(1, 9)))))
        w = rng.random(len(place))
        rows.append((i, int(i % 2), dict(zip(place.tolist(), (w / np.linalg.norm(w)).tolist(), strict=True))))
    index = toxicity.Index(np.arange(300, dtype=np.uint64), np.ones(300), rows, (1.0, 1.0), 0.1)
    assert 0 < index.wide[0] < 300 and len(index.posted)
    dense = np.zeros((len(rows), 300))
    for d, _, w in rows:
        dense[d, list(w)] = list(w.values())
    for n in (0, 1, 3) * 20:
        place = np.sort(np.concatenate((rng.choice(5, n, replace=False), rng.choice(np.arange(5, 300), 4, replace=False))))
        w = rng.random(len(place))
        w /= np.linalg.norm(w)
        got, cosine = index.nearest(place, w)
        want = np.sort(dense[:, place] @ w)[::-1][: toxicity.NEAREST]
        assert np.allclose(cosine, want[want > 0], atol=1e-6)
        assert np.allclose(dense[index.doc_id[got]][:, place] @ w, cosine, atol=1e-6)


def test_nearest_is_exact_on_documents(spark, sf_dir):
    """Over real texts, all at once: cosines of whole vectors, and blocks that are skipped."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.createDataFrame([(r.doc_id, int("damn" in r.text or r.doc_id % 9 == 0)) for r in docs.collect() if r.doc_id % 2], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    texts = [r.text for r in docs.where("doc_id % 3 = 0").collect()]
    doc, place, times = toxicity._places(pa.array(texts), index.vocabulary)
    slow = toxicity._counts(pa.array(texts))
    at = toxicity._find(index.vocabulary, slow[1])
    assert sorted(zip(doc.tolist(), place.tolist(), times.tolist())) == sorted((d, p, t) for d, p, t in zip(slow[0].tolist(), at.tolist(), slow[2].tolist()) if p >= 0)
    dense = np.zeros((len(index.doc_id), len(index.vocabulary)), np.float32)
    n, row, example, value = index.wide
    back = np.flatnonzero(index.row >= 0)
    dense[example, back[row]] = value
    dense[index.example, np.repeat(np.arange(len(index.size)), index.size)] = index.posted
    bound = np.searchsorted(doc, np.arange(len(texts) + 1))
    vectors = [(place[a:b], index.vector(place[a:b], times[a:b])) for a, b in zip(bound[:-1], bound[1:]) if b > a]
    worked = []
    for (p, w), (near, cosine) in zip(vectors, index.search(vectors, worked), strict=True):
        whole = dense[:, p] @ w
        want = np.sort(whole)[::-1][: toxicity.NEAREST]
        assert np.allclose(cosine, want[want > 1e-9], atol=1e-5) and np.allclose(whole[near], cosine, atol=1e-5)
    assert worked[0] < len(vectors) * index.blocks


def test_toxicity_searches_texts_without_toxic_terms(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(12)) + (" vile slur" if i % 8 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(80)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs.withColumn("held_out", F.col("doc_id") >= 80), toxicity.fit(docs, labels)).collect()}
    assert all(len(r.evidence) == 3 for r in out.values())
    assert all(out[i].evidence[0].doc_id == i and abs(out[i].evidence[0].cosine - 1) < 1e-5 for i in range(80))
    assert all((r.score >= 0.5) == (i % 8 == 0) for i, r in out.items())


def test_warc_of_pages(spark, sf_dir):
    """Every column against the contract, page by page."""
    rows = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op9_warc(spark, sf_dir).collect()} == brute.warc_rows(rows)


def test_warc_segments_and_repeats(spark, tmp_path):
    long = "é" * 5000 + "\r\n\r\nWARC/1.1\r\nz"
    rows = [(1, "http://a/x y", long), (1, "http://a/x y", long), (2, None, long), (2, None, long), (3, "http://b", None), (None, "http://q", "x" * 300), (4, "http://c", "y" * 1000), (5, "http://c", "y" * 1001)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("uid", F.lit(1)).withColumn("digest", F.lit("x"))
    warc.write_archives(pages, f"file://{tmp_path}/w", segment=1000)
    records = warc.read_records(spark, f"file://{tmp_path}/w").collect()
    assert len({r.record_id for r in records}) == len(records) and max(len(r.payload or b"") for r in records) <= 1000
    got = warc.captures(spark.createDataFrame(records, warc._RECORD)).withColumn("page", warc.page_of(F.col("metadata"))).collect()
    assert Counter((r.page, r.record_type) for r in got) == Counter([(1, "response"), (1, "revisit"), (2, "revisit"), (2, "revisit"), (3, "response"), (None, "response"), (4, "response"), (5, "response")])
    stored = {r.record_id: r for r in got if r.record_type == "response"}
    for r in got:
        own = stored[r.refers_to or r.record_id]
        body = next((h or "").encode() for p, _, h in rows if p == own.page)
        assert bytes(own.response.payload) == body and own.payload_bytes == len(body)
        assert r.payload_digest == hashlib.sha256(body).hexdigest() and len(r.requests) == 1


def test_exact_dedup(spark, rows):
    out = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.op7_exact_dedup(spark, SMALL).collect()}
    assert out == brute.exact_groups(rows)


def test_perfect_hash():
    for n in (0, 1, 2, 1000):
        keys = np.random.default_rng(n).integers(0, 1 << 63, (n, 2), dtype=np.uint64)
        assert sorted(exact_dedup.PerfectHash(keys).slots(keys).tolist()) == list(range(n))


def test_mixing(spark, sf_dir):
    docs = {r.doc_id: r for r in documents(spark, sf_dir).collect()}
    sizes, taken = Counter(), Counter()
    out = mixing.op8_mixing(spark, sf_dir).collect()
    for r in out:
        sizes[docs[r.doc_id].source] += r["size"]
        taken[docs[r.doc_id].source] += r.taken
        assert r["size"] == len(brute.WORD.findall(docs[r.doc_id].text)) and 0 <= r.taken <= 2 * r["size"]
    want = brute.mix_targets(sizes)
    assert all(abs(r.target - want[docs[r.doc_id].source]) < 1e-6 for r in out)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    mixed = mixing.mix_sources(spark, documents(spark, sf_dir), sf_dir).collect()
    assert sum(len(brute.WORD.findall(r.text)) for r in mixed) == sum(taken.values())


def test_language_id(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in documents(spark, sf_dir).collect()}
    out = [r for r in language_id.op10_language_id(spark, sf_dir).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.98 * len(out)


def test_language_id_against_a_plain_model(spark):
    """Counts, logs and sums in plain Python, over the same buckets; ties go to the language that sorts first."""
    import math

    m = (1 << 64) - 1

    def bucket(gram, n):
        h = 0
        for c in gram:
            h = (h * 0x100000001B3 + ord(c) + 1) & m
        x = (h + len(gram)) & m
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = ((x ^ (x >> shift)) * by) & m
        return x % n

    grams = lambda t, n: Counter(bucket(t[i : i + k], n) for k in (1, 2, 3) for i in range(len(t) - k + 1))
    rows = [(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (3, "le chien et le chat", "fr"), (4, "the house", "en"), (5, "das haus und", "de"), (6, "12 34", "en"), (7, "zz qq", "aa"), (8, "zz qq", "bb")]
    asked = [(10, "DER HUND"), (11, "the cat and"), (12, "chat et"), (13, "zz qq"), (14, "123"), (15, None), (16, "ü"), (17, "dog " * 200_000)]
    docs = spark.createDataFrame(asked, "doc_id long, text string")
    training = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, training, buckets=512).collect()}
    by = defaultdict(Counter)
    for _, t, lang in rows:
        by[lang] += grams(t, 512)
    for d, t in asked[:4] + asked[6:7]:
        own = grams(t.lower(), 512)
        z = {x: sum(n * math.log((c[g] + 1) / (c.total() + 512)) for g, n in own.items()) for x, c in by.items()}
        best = min(z, key=lambda x: (-round(z[x], 4), x))
        scale = min(own.total(), 100) / own.total()
        share = 1 / sum(math.exp((v - z[best]) * scale) for v in z.values())
        assert got[d][0] == best and abs(got[d][1] - share) < 1e-3, d
    assert got[13][0] == "aa" and got[14] == got[15] == ("und", 0.0) and got[17][0] == "en"


def test_many_languages_change_nothing(spark, monkeypatch):
    """Thousands of rare values of the language column, in blocks: the same as all at once, and memory stays small."""
    import tracemalloc

    rng = random.Random(4)
    rows = [(f"x{k:05d}", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(30))) for k in range(10_000)]
    rows += [("en", "the dog and the cat " * 20), ("de", "der hund und die katze " * 20)] * 5
    training = spark.createDataFrame(rows, "lang string, text string")
    model = language_id.train(training)
    assert len(model.langs) == 10_002 and model.total.sum() == sum(max(0, len(t) - k) for _, t in rows for k in range(3))
    texts = ["the cat", "die katze", rows[17][1], "q", "", "zz " * 30_000]
    tracemalloc.start()
    best, top = language_id.scores(model, texts, (1, 2, 3))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert [model.langs[b] for b in best[:3]] == ["en", "de", "x00017"]
    monkeypatch.setattr(language_id, "TOGETHER", 1 << 14)
    monkeypatch.setattr(language_id, "LOOKED_UP", 37)
    again, there = language_id.scores(model, texts[:5], (1, 2, 3))
    assert again.tolist() == best[:5].tolist() and np.allclose(there, top[:5])
    monkeypatch.setattr(language_id, "HELD", 100)  # counts are passed on in pieces
    few = language_id.train(training)
    assert few.langs == model.langs and few.total.tolist() == model.total.tolist() and np.array_equal(few.logs(5, 9), model.logs(5, 9))


def test_long_texts_lose_no_window(monkeypatch):
    texts = ["abcdefghij" * 7, "xy", "k" * 23, ""]
    whole = sorted(x for _, _, k, own in language_id._grams(texts, (1, 2, 3), 1 << 14) for x in k.tolist())
    monkeypatch.setattr(language_id, "CHARS", 10)
    assert sorted(x for _, _, k, own in language_id._grams(texts, (1, 2, 3), 1 << 14) for x in k.tolist()) == whole


def test_equal_cosines_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(i, "same text here") for i in (9, 3, 7, 5)] + [(1, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (9, 3, 7, 5, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs.withColumn("held_out", F.lit(False)), toxicity.fit(docs, labels)).collect()}
    assert [e.doc_id for e in out[9].evidence] == [3, 5, 7]


def test_sharding_against_plain_rules(spark, rows):
    """Sizes and checksums by Python; a row leaves its home shard only where that is full, and then for the next with room."""
    out = {r.doc_id: r for r in sharding.op2_sharding(spark, SMALL).collect()}
    counts = Counter(r.shard for r in out.values())
    assert max(counts.values()) - min(counts.values()) <= 1
    for d, t in rows:
        raw = (t or "").encode()
        assert (out[d]["size"], out[d].text_crc32, out[d].law, out[d].grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    bound = {s: len(rows) // 24 + (s < len(rows) % 24) for s in range(24)}
    assert all(counts[r.home_shard] == bound[r.home_shard] for r in out.values() if r.shard != r.home_shard)
    home = sharding.ring(24, 64)
    cells = {r.doc_id: r.key % sharding.CELLS for r in sharding.sized(documents(spark, SMALL)).collect()}
    assert all(out[d].home_shard == home[c] for d, c in cells.items())


def test_ranges_are_even_in_bytes():
    rng = random.Random(2)
    sizes = {c: rng.randrange(1, 50) for c in range(0, 3000, 3)} | {1: 9000, 2: 4000}
    table = packing.cut_ranges(sizes, 40)
    share = -(-sum(sizes.values()) // 40)
    load = Counter()
    for cell, first, n in table:
        for r in range(first, first + n):
            load[r] += sizes[cell] / n
    assert sorted(load) == list(range(len(load))) and max(load.values()) <= share and len(load) <= 2 * 40
    assert [c for c, _, _ in table] == sorted(sizes) and packing.cut_ranges({}, 8) == []


def test_ranges_are_intervals_of_the_curve(spark, sf_dir):
    """However many ranges there are, and with a third of the rows copies of one text: no range has keys within another's,
    but for copies; copies go to several; loads are even; near documents are neighbours."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    copies = spark.range(500).select((F.col("id") + 100_000).alias("doc_id"), F.lit("the same text again and again " * 40).alias("text"))
    rows = docs.union(copies)
    size = {r.doc_id: len((r.text or "").encode()) + packing.ROW for r in rows.collect()}
    for ranges in (7, 300):
        place = {r.doc_id: (r.sequence_id >> 40, r.curve_key) for r in packing.pack(rows, ranges=ranges).collect()}
        span, load = {}, Counter()
        for d, (at, key) in place.items():
            lo, hi = span.get(at, (key, key))
            span[at] = min(lo, key), max(hi, key)
            load[at] += size[d]
        order = sorted(span.values())
        assert all(a[1] <= b[0] for a, b in zip(order, order[1:], strict=False))
        share = -(-sum(size.values()) // ranges)
        assert max(load.values()) <= 2 * share + max(size.values())
        assert len({at for d, (at, _) in place.items() if d >= 100_000}) >= 0.2 * ranges
    keys = {key >> (packing.KEY_BITS - packing.CELL_BITS) for d, (_, key) in place.items() if d < 100_000}
    assert len(keys) > 300  # of at most 1,000 documents, copies among them


def test_large_cells_are_cut_by_the_rest_of_the_key(spark):
    rng = random.Random(5)
    keys = [(rng.randrange(1 << packing.KEY_BITS), 10) for _ in range(300)] + [((7 << 40) + rng.randrange(1 << 12), 10) for _ in range(600)] + [(5 << 30, 10)] * 200
    cells = packing.cells_of(spark.createDataFrame(keys, "curve_key long, size long"), 50)
    assert sum(cells.values()) == 11_000 and max(v for k, v in cells.items() if k != 5 << 30) <= 220 and cells[5 << 30] == 2000
    starts = sorted(cells)
    by = Counter()
    for k, n in keys:
        by[max(s for s in starts if s <= k)] += n
    assert by == cells


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Each stage's own input through a plain form of it."""
    import corpus_pipeline

    docs = documents(spark, SMALL).unionByName(spark.createDataFrame([(5001, "12 34 -- 5", "en", "x", 9), (5002, "", "de", None, 0), (5003, None, None, None, None)], documents(spark, SMALL).schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.keep(stage(spark, docs, SMALL), name)
        assert after.columns == docs.columns
        seen[name] = docs.collect(), after.collect()
        docs = after
    before, kept = seen["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in kept} >= {5001, 5002, 5003}
    assert len(kept) >= 0.97 * (len(before) - 3) and {tuple(r) for r in kept} <= {tuple(r) for r in before}
    before, kept = seen["exact_dedup"]
    groups = brute.exact_groups([(r.doc_id, r.text) for r in before])
    assert sorted(tuple(r) for r in kept) == sorted(tuple(r) for r in before if groups[r.doc_id][2])
    before, kept = seen["ngram_join"]
    component = brute.jaccard_components([(r.doc_id, r.text) for r in before])
    assert sorted(tuple(r) for r in kept) == sorted(tuple(r) for r in before if component[r.doc_id][1] == r.doc_id)
    before, mixed = seen["mixing"]
    words_of = lambda t: brute.WORD.findall(t or "")
    sizes, taken, by_id = Counter(), Counter(), {r.doc_id: r for r in before}
    for r in before:
        sizes[r.source] += len(words_of(r.text))
    for r in mixed:
        whole = by_id[r.doc_id]
        assert (whole.text or "").startswith(r.text) and (r.lang, r.source, r.n_chars) == (whole.lang, whole.source, len(r.text))
        taken[r.source] += len(words_of(r.text))
    want = brute.mix_targets(sizes)
    assert all(abs(taken[x] - want[x]) <= 1 for x in sizes)
    ids = packing.Ids()
    pieces = Counter()
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect():
        pieces[r.doc_id] += r.length
    tokens_ = Counter()
    for r in mixed:
        tokens_[r.doc_id] += len(ids(r.text)) + 1
    assert pieces == tokens_


def test_pipeline_on_empty_tables(spark, awkward):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, awkward[1]).collect() == []


def test_pipeline_keeps_columns(spark, awkward):
    import corpus_pipeline

    path, _, _ = awkward
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.keep(stage(spark, docs, path), name)
        assert docs.columns == columns
    kept = docs.select("doc_id", "text", "score").collect()
    assert {r.doc_id for r in kept} <= {1, 2, 3, 6, 7, 9, None} and all(r.score == 1 for r in kept)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() > 0


def test_language_training_holds_little(monkeypatch):
    """A batch of four languages, of which each run of texts has its own n-grams: counts are added up as they come, and the
    texts aren't all laid out at once."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(9)
    texts = ["".join(chr(rng.randrange(97, 1000)) for _ in range(2000)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([f"l{k % 4}" for k in range(2000)])], names=["text", "lang"])
    held = {}

    class Rows:
        select = lambda self, *columns: self

        def mapInArrow(self, f, schema):
            held["f"] = f
            raise StopIteration

    with pytest.raises(StopIteration):
        language_id.train(Rows())
    tracemalloc.start()
    counted = sum(b.column("n").to_numpy().sum() for b in held["f"](iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counted == sum(len(t) - k for t in texts for k in range(3)) and most < 64 << 20


def test_language_stage_sends_one_column_to_python(spark, monkeypatch):
    """Documents stay in the JVM; only lower-cased texts move, once, and what is told comes back."""
    docs = spark.createDataFrame([(1, "the dog and the cat", "en", "s", 19), (2, "der hund und die katze", "de", "s", 22), (3, "!", "en", None, 1), (4, None, "de", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = language_id.keep_identified(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "MapInArrow" not in plan
    assert sorted(r.doc_id for r in out.collect()) == [1, 2] and out.columns == docs.columns


def test_plain_texts_load_one_tokenizer():
    ids = packing.Ids()
    assert len(ids("plain text")) and "slow" not in vars(ids)
    assert ids("一").tolist() == ids.slow.encode("一", add_special_tokens=False).ids
    assert packing.ids_by() is packing.ids_by()
