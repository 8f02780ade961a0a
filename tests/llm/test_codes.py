"""Vector codes, spelling variants and line quality against plain Python forms, and on awkward tables."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import quality, spelling, vector_codes
from millrace.llm.common import documents
from millrace.llm.queries import ORACLE_SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("op", [vector_codes.op11_vector_codes, spelling.op12_spelling], ids=lambda f: f.__name__)
def test_matches_sql(spark, sf_dir, duck, op):
    df = op(spark, sf_dir)
    want = duck.sql(ORACLE_SQL[op.__name__])
    order = [want.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in order) for r in want.fetchall())


def _plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, label, components or None). Rows of op11 without the labels' sums, and the digest."""
    kept = [(i, b, [math.floor(4096 * x) for x in v]) for i, b, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    size = len(kept[0][2])
    cut = [size * p // parts for p in range(parts + 1)]
    part = lambda v, p: v[cut[p] : cut[p + 1]]
    books = [[part(r[2], p) for r in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min((far(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, _, v in kept:
                own[best(part(v, p), books[p])[1]].append(part(v, p))
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, b, v in kept:
        told = [best(part(v, p), books[p]) for p in range(parts)]
        out.append((i, b, "".join(f"{k:02x}" for _, k in told), sum(d for d, _ in told)))
    return out, sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, id string, v int, kin int, code string"


def _tables(spark, path, rows, kind="float"):
    spark.createDataFrame([(i, v, b, "x", 1, 2, "y") for i, b, v in rows], VECTORS.replace("float", kind)).write.parquet(f"{path}/embeddings.parquet")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_codes_on_awkward_rows(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    vector = lambda n=64: [float(x) for x in rng.integers(-6, 7, n) / 64]
    rows = [(int(rng.integers(0, 400)), [1, None, 7][i % 3], vector()) for i in range(150)]  # ids repeat
    same = vector()
    rows += [(5000 + i, 1, same) for i in range(300)]  # one vector that is everywhere
    rows += [(None, None, vector()), (None, 2, vector()), (900, 1, None), (901, 1, [math.nan, *vector(63)]), (902, 1, [*vector(63), math.inf]), (903, 1, [None, *vector(63)]), (904, 1, vector(60)), (905, 1, []), (906, 1, [1e4] * 64), (907, 1, [-3e4] * 64)]
    _tables(spark, tmp_path, rows, kind)
    got = vector_codes.op11_vector_codes(spark, f"file://{tmp_path}").collect()
    want, digest = _plain_codes(rows)
    assert Counter((r.vec_id, r.code, r.error) for r in got) == Counter((i, c, e) for i, _, c, e in want)
    assert {r.codebooks_sha256 for r in got} == {digest}
    sums = defaultdict(int)
    for _, b, _, e in want:
        sums[b] += e
    assert {(r.vec_id, r.code, r.label_error) for r in got} == {(i, c, sums[b]) for i, b, c, _ in want}


def test_vector_codes_of_few_odd_and_huge_vectors(spark, tmp_path):
    few = [(i, 0, [float(i * j) for j in range(11)]) for i in range(5)]  # fewer than entries, and 11 isn't 8 parts
    _tables(spark, tmp_path / "few", few)
    want, digest = _plain_codes(few)
    got = vector_codes.op11_vector_codes(spark, f"file://{tmp_path}/few").collect()
    assert {(r.vec_id, r.code, r.error, r.codebooks_sha256) for r in got} == {(i, c, e, digest) for i, _, c, e in want}
    _tables(spark, tmp_path / "huge", [(i, 0, [3e38 * (-1) ** (i // 16 + j) for j in range(64)]) for i in range(40)])
    got = vector_codes.op11_vector_codes(spark, f"file://{tmp_path}/huge").collect()
    assert len(got) == 40 and {r.label_error for r in got} == {min((1 << 63) - 1, sum(r.error for r in got))}
    _tables(spark, tmp_path / "none", [])
    _tables(spark, tmp_path / "void", [(1, 1, None), (2, 1, [math.nan])])
    for name in ("none", "void"):
        assert vector_codes.op11_vector_codes(spark, f"file://{tmp_path}/{name}").collect() == []


def test_bounds_lose_no_entry():
    """Against all distances, for scattered, equal, tied and large components; and they do spare distances."""
    rng = np.random.default_rng(8)
    for width in (1, 2, 3, 7, 8, 50):
        for spread in (1, 3, 500, 1 << 20, 1 << 27):
            x, book = rng.integers(-spread, spread + 1, (400, width)), rng.integers(-spread, spread + 1, (16, width))
            x[:50] = book[rng.integers(0, 16, 50)]
            book[9] = book[4]
            far = ((x[:, None].astype(object) - book) ** 2).sum(axis=2)
            index, error, _ = vector_codes.nearest(x, book)
            assert error.tolist() == far.min(axis=1).tolist() and index.tolist() == far.argmin(axis=1).tolist()
    centres = rng.integers(-2000, 2000, (16, 8))
    x = centres[rng.integers(0, 16, 5000)] + rng.integers(-200, 200, (5000, 8))
    assert vector_codes.nearest(x, centres)[2] < 0.25 * 16 * len(x)


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _plain_words(rows):
    counts = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _plain_variants(counts):
    """word -> (form, root, n, n_near, form_n)."""
    by = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add((w, i))
    near = defaultdict(set)
    for s, own in by.items():
        for w, i in own:
            near[w] |= {v for v, j in own if i == j and v != w} | ({s} if s in counts else set())
            if s in counts:
                near[s].add(w)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return out


def _told(df):
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def test_spelling_on_awkward_rows(spark, tmp_path):
    rng = random.Random(2)
    edit = lambda w: (lambda i, k: w[:i] + (rng.choice("abzéÿ") if k else "") + w[i + (k < 2) :])(rng.randrange(len(w)), rng.randrange(3))
    words = ["walnut", "WALNUT", "Ünder", "naïve×x", "aaaaaaa", "aaaaaa", "élan", "x" * 300, "y" * 70 + "z", "ab" * 24]
    words += [edit(w) for w in words for _ in range(30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(200)) + "7" + rng.choice(words)) for i in range(60)]
    rows += [(5, "walnut " * 100_000), (None, "walnut naïve"), (6, None), (6, ""), (7, " 12 \n")] + rows[:3]
    docs = spark.createDataFrame([(d, t, "w", 1, 2) for d, t in rows], "doc_id long, text string, word string, n int, base int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert _told(spelling.op12_spelling(spark, f"file://{tmp_path}")) == _plain_variants(_plain_words(rows))
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert spelling.op12_spelling(spark, f"file://{tmp_path}/empty").collect() == []


@pytest.mark.parametrize("most", [2, 7, 48])
def test_large_blocks_are_subdivided(spark, most):
    """Thousands of words with one beginning, one end, or both; runs of one letter; a chain of forms."""
    rng = random.Random(most)
    pick = lambda n: "".join(rng.choice("ab") for _ in range(n))
    words = {"stem" + pick(9) for _ in range(400)} | {pick(9) + "tail" for _ in range(400)} | {"x" + pick(k) + "y" for k in range(4, 9) for _ in range(60)} | {"o" * k for k in range(5, 40)}
    words |= {"k" + c for c in map("".join, itertools.product("pqrs", repeat=4))}
    counts = {w: rng.choice([3, 4, 6, 8, 12, 24, 50, 101]) for w in sorted(words)}
    counts |= {"chain" + "w" * i: 3 * 2**i for i in range(12)}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")) if most == 48 else None
    if got is None:
        near = {r.word: (r.n_near, r.best.word) for r in spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), most).collect()}
        want = {w: n for w, (_, _, _, n, _) in _plain_variants(counts).items() if n}
        assert {w: n for w, (n, _) in near.items()} == want
    else:
        told = _told(got)
        assert told == _plain_variants(counts) and told["chain"][1] == "chain" + "w" * 11


def test_a_dictionary_longer_than_a_scan(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SCAN", 64)
    words = ["".join(c) for c in itertools.product("abcd", repeat=5)]
    batch = pa.RecordBatch.from_pydict({"word": words, "n": [3] * len(words), "base": [5] * len(words), "hi": [5] * len(words), "block": [int(w[:2] == "aa") * 7 + ord(w[1]) * 256 + ord(w[0]) for w in words]}, schema=pa.schema([("word", pa.string()), ("n", pa.int64()), ("base", pa.int32()), ("hi", pa.int32()), ("block", pa.int64())]))
    pieces = [batch.slice(i, 37) for i in range(0, len(words), 37)]
    got = Counter(w for b in spelling._scan(iter(pieces)) for w in b.column("word").to_pylist())
    assert got == {w: 9 for w in words}  # three places behind the beginning, three other letters


def test_marginals_sum_over_all_labels():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        odds, steps = rng.normal(0, 2, n), rng.normal(0, 1, (2, 2))
        weight = {y: math.exp(sum(o * k for o, k in zip(odds, y, strict=True)) + sum(steps[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=n)}
        total = sum(weight.values())
        pad = rng.normal(0, 1, 3)  # another chain before, and empty ones
        p, both = quality.marginals(np.concatenate((pad, odds)), steps, np.array([0, 0, 3, 3, 3 + n, 3 + n]))
        alone, first = quality.marginals(pad, steps, np.array([0, 3]))
        want = [sum(w for y, w in weight.items() if y[t]) / total for t in range(n)]
        assert np.allclose(p[3:], want) and np.allclose(p[:3], alone)
        pairs = np.array([[sum(w * sum((y[t], y[t + 1]) == (a, b) for t in range(n - 1)) for y, w in weight.items()) / total for b in (0, 1)] for a in (0, 1)])
        assert np.allclose(both - first, pairs)


def test_lines_by_hand():
    texts = ["Go go go 12!!\n\n x | x \nGo go go 12!!", None, " \n", "Äb$ c.\r\nd"]
    x, size, off = quality.lines(pa.array(texts))
    named = [dict(zip(quality.NAMES, r, strict=True)) for r in x.tolist()]
    assert off.tolist() == [0, 3, 3, 3, 5] and size.tolist() == [13, 5, 13, 7, 1]
    assert named[0]["echoes"] == pytest.approx(2 / 4) and named[0]["distinct"] == pytest.approx(2 / 4) and named[0]["shouts"] == pytest.approx(2 / 4) and named[0]["digits"] == pytest.approx(2 / 13) and named[0]["capitals"] == pytest.approx(1 / 6)
    assert [r["again"] for r in named] == [1, 0, 1, 0, 0] and [r["new"] for r in named] == [0.5, pytest.approx(2 / 3), 0, 1, 1]
    assert named[1]["single"] == 1 and named[1]["symbols"] == pytest.approx(1 / 5) and named[3]["ends"] == 1 and named[4]["ends"] == 0
    one, _, _ = quality.lines(pa.array([texts[3]]))
    assert np.array_equal(one, x[3:])
    assert np.array_equal(quality.lines(pa.array(texts).slice(2))[0], x[3:])


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = quality.op13_quality(spark, sf).collect()
    ids = [r.doc_id for r in documents(spark, sf).select("doc_id").collect()]
    assert Counter(r.doc_id for r in out) == Counter(ids)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    bad = [r for r in held if not labels[r.doc_id]]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.985 * len(held)
    assert sum(not r.predicted for r in bad) >= 0.9 * len(bad)


def test_quality_on_awkward_rows(spark, tmp_path):
    rng = random.Random(6)
    good = lambda: "\n".join(" ".join(rng.choice("the quick brown fox likes a lazy dog".split()) for _ in range(12)) + "." for _ in range(5))
    bad = lambda: "\n".join("$$$ ### " * 9 for _ in range(5))
    rows = [(i, bad() if i % 3 == 0 else good()) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, good() + "\n" + good()), (203, good()), (None, bad()), (204, "one line " * 200_000), (205, "a\n" * 50_000), rows[4]]
    path = str(tmp_path)
    spark.createDataFrame([(d, t, 1, 2, 0.5) for d, t in rows], "doc_id long, text string, good int, key int, score double").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0, "t") for i in range(120)] + [(4, None, 0, "t"), (None, 0, 0, "t"), (5, 1, 0, "t"), (201, 1, 0, "t")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{path}/labels.parquet")
    got = quality.op13_quality(spark, f"file://{path}").collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 120)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.score)
    assert by[200] == by[201] == by[202] and len(by[4]) == 1 and all(0 <= s <= 1 for own in by.values() for s in own)
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{path}/empty/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{path}/empty/labels.parquet")
    assert quality.op13_quality(spark, f"file://{path}/empty").collect() == []
    spark.read.parquet(f"{path}/documents.parquet").write.parquet(f"{path}/bare/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{path}/bare/labels.parquet")
    assert {(r.score, r.predicted) for r in quality.op13_quality(spark, f"file://{path}/bare").collect()} == {(0.0, 0)}
