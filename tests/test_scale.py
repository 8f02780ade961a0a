"""What is built to hold at any size: index and pivot joins, quantiles, numbered lines, growing folders, calls that persist."""

import itertools
import json
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import calls, extraction, gate, live, quantiles, reports, review, similarity, vectors
from millrace.sources import files, scratch
from millrace.streaming import incremental


def _gram_set(text):
    s = " ".join(text.lower().split())
    return {s[i : i + 3] for i in range(len(s) - 2)} if len(s) >= 3 else ({s} if s else set())


def _like(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.fixture(scope="module")
def texts():
    """Groups of near texts around the threshold, short ones, and many that share much without being near."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    out = []
    for size in (1, 2, 3, 5, 9, 30, 80):
        for _ in range(6):
            base = [word() for _ in range(size)]
            out.append(" ".join(base))
            for k in (1, 1, 2, 4):
                own = list(base)
                for _ in range(k):
                    own[rng.randrange(size)] = word()
                out.append(" ".join(own))
    common = [word() for _ in range(40)]
    out += [" ".join(common + [word() for _ in range(12)]) for _ in range(60)]
    return dict(enumerate(out)) | {1000: "", 1001: None, 1002: "ab", 1003: "AB "}


@pytest.mark.parametrize(("threshold", "block"), [(0.9, 1024), (0.9, 3), (0.6, 16), (0.97, 1)])
def test_index_misses_no_pair(spark, texts, threshold, block):
    sets = {i: _gram_set(t or "") for i, t in texts.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if _like(sets[a], sets[b]) >= threshold}
    bits = similarity.with_bits(spark.createDataFrame(list(texts.items()), "id long, text string"))
    found = [(r.a, r.b) for r in similarity.candidate_pairs(bits, threshold=threshold, block=block).collect()]
    assert len(found) == len({*found}) and want <= {*found}
    assert {(r.a, r.b) for r in similarity.similar_pairs(bits, threshold=threshold).collect()} == want


def test_index_of_two_tables(spark, texts):
    rows = [(f"x{i}", t) for i, t in texts.items()]
    bits = similarity.with_bits(spark.createDataFrame(rows, "id string, text string"))
    left, right = bits.where(F.substring("id", -1, 1) == "0"), bits.where(F.substring("id", -1, 1) != "0")
    sets = {i: _gram_set(t or "") for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a[-1] == "0" != b[-1] and _like(sets[a], sets[b]) >= 0.9}
    assert {(r.a, r.b) for r in similarity.similar_pairs(left, right).collect()} == want and want
    assert {(r.a, r.b) for r in similarity.candidate_pairs(left, right, block=2).collect()} >= want


def test_no_group_takes_a_hot_key_whole(spark):
    """Thousands of sets that share a part: blocks stay small, and pairs are found across them."""
    rng = random.Random(3)
    base = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    rows = [(i, base + f" {rng.randrange(10**6):06d}") for i in range(1500)]
    bits = similarity.with_bits(spark.createDataFrame(rows, "id long, text string"))
    groups = similarity.index_blocks(bits, block=100).groupBy("key", "x", "y").count()
    assert groups.agg(F.max("count")).first()[0] <= 2 * 180  # hashed into blocks of about 100
    pairs = {(r.a, r.b) for r in similarity.candidate_pairs(bits, block=100).collect()}
    sets = {i: _gram_set(t) for i, t in rows[:60]}
    assert {(a, b) for a, b in itertools.combinations(sets, 2) if _like(sets[a], sets[b]) >= 0.9} <= pairs


def _unit_pairs(rows, threshold):
    x = np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {(min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1)), strict=True) if rows[i][0] != rows[j][0]}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pivot_cells_lose_no_pair(spark, kind, monkeypatch):
    monkeypatch.setattr(vectors, "SLICE", 150)
    rng = np.random.default_rng(5)
    name = (lambda i: i) if kind == "long" else (lambda i: f"seed-{i:05d}")
    centres = rng.normal(0, 1, (12, 10))
    rows = [(name(i), [float(v) for v in centres[i % 12] + rng.normal(0, 0.12, 10)]) for i in range(900)]
    rows += [(name(2000 + i), rows[7][1]) for i in range(120)]  # one vector, many times
    odd = [(name(5000), None), (name(5001), [0.0] * 10), (name(5002), [math.nan] * 10), (name(5003), [1.0] * 9 + [math.inf]), (name(5004), [1.0] * 9 + [None]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows + odd, f"id {kind}, v array<double>")
    for threshold, block in ((0.9, 25), (0.97, 200), (0.9, 5000)):
        got = [(r.a, r.b) for r in vectors.cosine_pairs(frame, threshold, block).collect()]
        assert len(got) == len({*got}) and {*got} == _unit_pairs(rows, threshold)
    assert vectors.share_met(vectors.whole_vectors(frame), 0.97, 25) < 0.3
    assert vectors.cosine_pairs(frame.limit(0)).collect() == []
    kept = {r.id for r in similarity.dedup_texts(frame.where("id is not null").select("id"), "embedding", vectors=frame).where("kept").collect()}
    assert {i for i, _ in odd if i is not None} <= kept and len(kept) < 60
    with pytest.raises(ValueError, match="components"):
        vectors.cosine_pairs(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"))


@pytest.mark.parametrize("few", [5, 400, 10**6])
def test_exact_quantiles(spark, few):
    rng = random.Random(few)
    groups = {
        "flat": [float(i) for i in range(500)], "same": [7.25] * 700, "two": [1.0, 2.0], "one": [-3.5], "signs": [rng.uniform(-1, 1) * 10 ** rng.randrange(-200, 200) for _ in range(300)],
        "zeros": [0.0, -0.0] * 50 + [1e-320], "ends": [math.inf, -math.inf, 0.0, 5.0, math.nan], None: [rng.gauss(0, 1) for _ in range(200)],
    }
    rows = [(g, v) for g, own in groups.items() for v in own] + [("flat", None), ("void", None)]
    rng.shuffle(rows)
    at = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {r.g: (r.n, r.q) for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", at, ("g",), few).collect()}
    assert got.keys() == groups.keys()

    def plain(own, p):
        order = sorted(own, key=lambda x: (math.isnan(x), x))
        place = p * (len(order) - 1)
        low, high = order[math.floor(place)], order[math.ceil(place)]
        return low if low == high else low + (place - math.floor(place)) * (high - low)

    for g, own in groups.items():
        assert got[g][0] == len(own)
        assert np.allclose(got[g][1], [plain(own, p) for p in at], equal_nan=True, rtol=1e-12, atol=0), g
    frame = spark.createDataFrame([(v,) for v in groups["signs"]], "v double")
    whole = quantiles.exact_quantiles(frame, "v", (0.5,), few=few).collect()
    assert len(whole) == 1 and whole[0].q[0] == pytest.approx(plain(groups["signs"], 0.5), rel=1e-12)
    assert quantiles.exact_quantiles(frame.limit(0), "v", (0.5,)).collect() == []
    assert "percentile" not in reports.latencies(frame, "v")._jdf.queryExecution().toString()


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Files of many splits, with blank lines, other line ends, and none at the end."""
    rng = random.Random(1)
    want = {}
    for name, end in (("a.jsonl", "\n"), ("b.jsonl", "\r\n"), ("c.jsonl", "\n")):
        lines = [rng.choice(["", '{"id": %d}' % i, '{"id": ', '"ä%s"' % ("x" * rng.randrange(200))]) for i in range(3000)] + ["[1] 2"]
        (tmp_path / name).write_bytes(end.join(lines).encode() + (b"" if name == "c.jsonl" else end.encode()))
        want |= {(name, i): t for i, t in enumerate(lines, 1)}
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in was:
            spark.conf.set(k, "7000")
        rows = files.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 40
        got = {(os.path.basename(r.file), r.line): r.value for r in rows.collect()}
        assert got == want
        bad = {(os.path.basename(r.file), r.line) for r in files.bad_lines(spark, str(tmp_path)).collect()}
        assert bad == {k for k, t in want.items() if t in ('{"id": ', "[1] 2")}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_growing_folder_is_read_once(spark, tmp_path):
    folder, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    said = "id long, output string"
    seen = []
    for run in range(3):
        for k in range(2):
            lines = [json.dumps({"id": run * 10 + k, "output": "{}"}), "", "not json"][: 3 if run else 1]
            (tmp_path / "in" / f"{run}-{k}.json").write_text("\n".join(lines))
        rows = incremental.gate_new(spark, folder, out, state, said, files_a_batch=1).collect()
        seen.append(Counter((r.id, os.path.basename(r.file)) for r in rows))
        assert max(seen[-1].values()) == 1 and all(r._drop_reason for r in rows)
        assert {r._broken for r in rows if r.id is None} <= {"not json"}
    assert seen[0] <= seen[1] <= seen[2] and {i for i, _ in seen[2] if i is not None} == {0, 1, 10, 11, 20, 21} and sum(seen[2].values()) == 10
    before = {r.batch for r in spark.read.parquet(out).select("batch").distinct().collect()}
    incremental.gate_new(spark, folder, out, state, said)
    assert {r.batch for r in spark.read.parquet(out).select("batch").distinct().collect()} == before  # nothing new, no batch


def _counting(path):
    """A caller that writes a file for every call that it gets."""

    def call(row):
        with open(f"{path}/{row['key']}", "a") as f:
            f.write("x")
        if row["key"].startswith("bad"):
            raise ValueError("refused")
        return row["key"].upper()

    return call


def test_replies_persist(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    call, folder = _counting(f"{tmp_path}/calls"), f"file://{tmp_path}/replies"
    asked = spark.createDataFrame([(f"k{i % 30}", i) for i in range(90)] + [("bad1", 0)], "key string, n long")
    first = live.memoised(asked, call, folder, pieces=4).collect()
    assert len(first) == 91 and not any(r.cached for r in first)
    assert all(r.reply == r.key.upper() and r.error is None for r in first if r.key != "bad1") and [r.error for r in first if r.key == "bad1"] == ["refused"]
    second = live.memoised(asked.union(spark.createDataFrame([("new", 1)], "key string, n long")), call, folder, pieces=4).collect()
    assert {r.key for r in second if not r.cached} == {"bad1", "new"}
    counts = {p.name: len(p.read_text()) for p in (tmp_path / "calls").iterdir()}
    assert counts == {f"k{i}": 1 for i in range(30)} | {"bad1": 2, "new": 1}  # only what failed is called again
    assert live.compacted(spark, folder) > 1 and len(live.committed(spark, folder)) == 1
    assert all(r.cached for r in live.memoised(asked.where("key <> 'bad1'"), call, folder).collect())
    assert {p.name: len(p.read_text()) for p in (tmp_path / "calls").iterdir()} == counts


def test_a_killed_run_repeats_nothing_committed(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    call, folder = _counting(f"{tmp_path}/calls"), f"file://{tmp_path}/replies"
    asked = spark.createDataFrame([(f"k{i}",) for i in range(60)], "key string")
    real, done = live.commit, []

    def dies(session, at, name):
        if len(done) == 2:
            raise RuntimeError("killed")  # the piece is written, and not committed
        done.append(name)
        real(session, at, name)

    live.commit = dies
    try:
        with pytest.raises(RuntimeError, match="killed"):
            live.memoised(asked, call, folder, pieces=5)
    finally:
        live.commit = real
    kept = {r.key for r in live.read_committed(spark, folder, live.REPLIES).collect()}
    assert 0 < len(kept) < 60
    out = live.memoised(asked, call, folder, pieces=5).collect()
    assert {r.key for r in out if r.cached} == kept and all(r.reply == r.key.upper() for r in out) and len(out) == 60
    assert all((tmp_path / "calls" / k).read_text() == "x" for k in kept)


def test_asking_until_a_reply_passes(spark, tmp_path):
    """Rounds against the loop for one document; a run that is stopped goes on; no more attempts than retries + 1."""
    good = json.dumps({"vendor": "V", "date": "2024-01-02", "currency": "USD", "line_items": [{"description": "d", "qty": 1, "unit_price": 2, "total": 2}], "subtotal": 2, "tax": 0, "grand_total": 2, "payment_terms": None})
    (tmp_path / "asked").mkdir()

    def reply(i, attempt):
        return good if i % 4 == attempt else "{}" if i % 4 == 0 else f"no {attempt}"

    def call(row):
        with open(f"{tmp_path}/asked/{row['id']}-{row['attempt']}", "a") as f:
            f.write(f"{len(row['messages'])} {row['temperature']} {row['constrained']}\n")
        if row["id"] == 99:
            raise ValueError("refused")
        return reply(row["id"], row["attempt"])

    seeds = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(99, "t")], "id long, text string")
    log = live.labelled(seeds, call, f"file://{tmp_path}/live", "S", pieces=2)
    got = {r.id: r for r in calls.resolve(log).collect()}

    def plain(i):
        for attempt in (1, 2, 3):
            if i % 4 == attempt and i != 99:
                return True, attempt
        return False, 3

    assert {i: (r.valid, r.attempts) for i, r in got.items()} == {i: plain(i) for i in [*range(20), 99]}
    asked = {p.name: p.read_text() for p in (tmp_path / "asked").iterdir()}
    assert asked.keys() == {f"{i}-{a}" for i in [*range(20), 99] for a in range(1, plain(i)[1] + 1)}
    assert asked["0-1"] == "2 0.0 False\n" and asked["0-2"] == asked["0-3"] == "4 0.3 True\n"
    assert live.labelled(seeds, call, f"file://{tmp_path}/live", "S").count() == log.count()  # all is answered: nothing is asked
    assert {p.name: p.read_text() for p in (tmp_path / "asked").iterdir()} == asked


def test_upsert_writes_touched_partitions_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(i, i % 3, f"v{i}", None if i % 2 else 1) for i in range(30)], "id long, part int, v string, w int").write.partitionBy("part").parquet(path)
    files_of = lambda p: {x.name: x.stat().st_mtime_ns for x in (tmp_path / "t" / f"part={p}").iterdir()}
    before = {p: files_of(p) for p in range(3)}
    updates = spark.createDataFrame([(4, "new", 0.5), (7, None, 0.25), (999, "nowhere", 1.0)], "id long, v string, extra double")
    for _ in range(2):  # the second changes nothing
        files.upsert(updates, path, "part")
        got = {r.id: (r.part, r.v, r.w, r.extra) for r in spark.read.option("mergeSchema", True).parquet(path).collect()}
        assert got == {i: (i % 3, {4: "new", 7: None}.get(i, f"v{i}"), None if i % 2 else 1, {4: 0.5, 7: 0.25}.get(i)) for i in range(30)}
    assert files_of(0) == before[0] and files_of(2) == before[2] and files_of(1) != before[1]
    with pytest.raises(Exception, match="more than one update of 4"):
        files.upsert(updates.union(updates.where("id = 4")), path, "part")


def _flat(spark, rows):
    frame = spark.createDataFrame([(i, json.dumps(p), json.dumps(g)) for i, (p, g) in enumerate(rows)], "id long, p string, g string")
    return extraction.compare(extraction.flatten_json(frame, "p"), extraction.flatten_json(frame, "g"))


def test_raw_values_match_as_numbers_or_not_at_all(spark):
    cases = [
        ("vendor", {"a": 1}, "V", False, "wrong_text"), ("vendor", {"a": 1}, {"a": 1}, True, None), ("vendor", "v  A", "V a", True, None), ("vendor", 5, 5.004, True, None), ("vendor", "5", 5, False, "wrong_text"),
        ("tax", "n/a", "n/a", False, "wrong_money"), ("total", "x", "x", None, None), ("grand_total", [1], [1], False, "wrong_money"), ("tax", "1d", 1.0, False, "wrong_money"), ("tax", "1f", "1f", False, "wrong_money"),
        ("tax", " 12.5 ", 12.5, True, None), ("tax", "1_0.0", 10, True, None), ("tax", ".5e1", 5, True, None), ("tax", "5.", 5, True, None), ("tax", "1__0", 10, False, "wrong_money"), ("tax", True, 1, True, None), ("tax", "inf", "inf", False, "wrong_money"), ("tax", None, 1, False, "missing_field"), ("tax", 1, None, False, "hallucinated_field"), ("tax", None, None, True, None),
        ("tax", {"n": 1}, None, False, "hallucinated_field"), ("date", ["x"], "2024-01-01", False, "wrong_date"),
    ]
    fields = extraction.categorise(_flat(spark, [({k: p}, {k: g}) for k, p, g, *_ in cases])).collect()
    told = {r.id: (r.same, r.category) for r in fields}
    for i, (k, p, g, same, category) in enumerate(cases):
        if same is not None:  # a top field of that name doesn't exist otherwise
            assert told[i] == (same, category), (k, p, g, told[i])
    lines = [({"line_items": [{"qty": "two", "total": "x"}]}, {"line_items": [{"qty": "two", "total": "x"}]})]
    assert {(r.path, r.category) for r in extraction.categorise(_flat(spark, lines)).collect()} == {("line_items[0].qty", "wrong_qty"), ("line_items[0].total", "wrong_money")}


def test_records_meet_like_their_fields(spark):
    """Fields that meet within a row are those that meet by a join, and one row a document and side is shuffled."""
    rng = random.Random(7)

    def invoice():
        some = {"vendor": rng.choice(["V", {"a": 1}, None]), "tax": rng.choice([1, "1.0", "x"]), "total": 1, "line_items": [rng.choice([4, {"qty": rng.choice([1, "two", None])}, {"total": 2.004}]) for _ in range(rng.randrange(4))]}
        return json.dumps({k: v for k, v in some.items() if rng.random() < 0.8})

    rows = spark.createDataFrame([(i, invoice() if i % 7 else "[1]", invoice() if i % 5 else None) for i in range(120)], "id long, p string, g string")
    pred, gold = rows.where("id % 11 <> 3"), rows.where("id % 13 <> 4")
    by_field = extraction.compare(extraction.flatten_json(pred, "p"), extraction.flatten_json(gold, "g"))
    by_row = extraction.compare_records(extraction.records(pred, "p"), extraction.records(gold, "g"))
    columns = sorted(by_field.columns)
    assert sorted(by_row.columns) == columns
    assert Counter(map(repr, by_row.select(columns).collect())) == Counter(map(repr, by_field.select(columns).collect()))
    plan = by_row._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # fields come apart above the join


def test_silver_fields(spark):
    invoice = {"vendor": "V", "date": "2024-01-02", "currency": "USD", "line_items": [{"description": "d", "qty": 1.0, "unit_price": 2.0, "total": 2.0}], "subtotal": 2.0, "tax": 0.0, "grand_total": 2.0, "payment_terms": None}
    kind = gate.validate(F.lit("{}"))["invoice"]
    shape = spark.range(1).select(kind.alias("i")).schema["i"].dataType.simpleString()
    replies = [(1, json.dumps(invoice), None), (2, json.dumps(invoice | {"tax": 1.0}), None), (3, "no", None), (4, "{}", None), (5, None, "timed out " * 10), (6, json.dumps(invoice), "late")]
    rows = spark.createDataFrame(replies, "id long, reply string, error string").withColumn("gold", F.from_json(F.lit(json.dumps(invoice)), shape))
    got = {r.id: r for r in review.silver_fields(rows, "m2").collect()}
    assert got[1][1:] == (True, "m2", 1.0, None) and got[2][1:] == (False, "m2", round(10 / 11, 4), None)
    assert got[3][1:] == (False, "m2", 0.0, "verifier-invalid: no JSON found") and got[4].silver_note.startswith("verifier-invalid: ") and len(got[4].silver_note) <= 78
    assert got[5].silver_note == "verifier-invalid: " + ("timed out " * 10)[:60] and not got[6].silver_verified
    rate = review.silver_rate(review.silver_fields(rows, "m2")).first()
    assert (rate.n, rate.verified, rate.invalid, rate.rate) == (6, 1, 4, pytest.approx(1 / 6))


def test_no_task_sorts_a_whole_stratum(spark):
    items = spark.range(2000).selectExpr("id", "case when id % 3 = 0 then 'a' else 'b' end as stratum", "(id * 7919) % 1000 / 1000.0d as informativeness")
    plan = review.stratified_sample(items, 25)
    told = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in told and "Partial" in told
    got = Counter(r.stratum for r in plan.collect())
    assert got == {"a": 8, "b": 17}


def test_labelling_leaves_no_copies_of_requests(spark, tmp_path):
    """What a round writes for itself is gone when its replies are committed; only failures stay."""
    seeds = spark.createDataFrame([(i, f"text {i} " + "x" * 200) for i in range(300)], "id long, text string")
    before = {*_shared(spark)}
    log = live.labelled(seeds, lambda row: "none", str(tmp_path / "live"), "S", retries=1, pieces=2)
    assert log.count() == 600 and {r.attempt for r in log.select("attempt").distinct().collect()} == {1, 2}
    assert {*_shared(spark)} == before


def _shared(spark):
    at = scratch.shared_dir(spark).removeprefix("file:")
    return os.listdir(at) if os.path.isdir(at) else []


@pytest.mark.parametrize("laid_out", [64 << 20, 0])
def test_pairs_are_checked_in_their_groups(spark, texts, laid_out, monkeypatch):
    """A row is dealt to two cells of one block, whatever its grams; and pairs are checked by the sets of their group, over
    small blocks, with and without bits, of one table and of two that share their ids."""
    rows = [(i, t) for i, t in texts.items()]
    bits = similarity.with_bits(spark.createDataFrame(rows, "id long, text string")).cache()
    assert similarity.index_blocks(bits).count() == 2 * bits.where("n > 0").count()
    monkeypatch.setattr(similarity, "SETS", laid_out)
    sets = {i: _gram_set(t or "") for i, t in rows}
    like = {(a, b): round(_like(sets[a], sets[b]), 9) for a in sets for b in sets if _like(sets[a], sets[b]) >= 0.7}
    found = {(r.a, r.b): round(r.similarity, 9) for r in similarity.similar_pairs(bits, threshold=0.7, block=5).collect()}
    assert found == {k: v for k, v in like.items() if k[0] < k[1]}
    met = similarity.similar_pairs(bits, bits, threshold=0.7, block=40).collect()
    assert len(met) == len(like) and {(r.a, r.b): round(r.similarity, 9) for r in met} == like


def test_pairs_are_scored_a_row_a_line(spark):
    """The scores of compared fields, of lines that are null or on one side alone, ids that occur twice, and no struct; and
    no row a field on the way."""
    line = lambda **x: {n: x.get(n) for n in gate.LINE_FIELDS}
    inv = lambda **x: {n: x.get(n) for n in gate.FIELDS}
    rows = [
        (1, None, None),
        (2, inv(vendor="A  b"), None),
        (3, None, inv(line_items=[line(qty=1.0), None, line(total=2.0)])),
        (4, inv(vendor="STRASSE x", line_items=[None, line(qty=1.00009, description="a"), line(qty=2.0)]), inv(vendor="straße  x ", line_items=[None, line(qty=1.0, description=" A "), None])),
        (5, inv(tax=float("nan"), line_items=[]), inv(tax=float("nan"))),
        (6, inv(tax=1.009), inv(tax=1.0, line_items=[])),
        (7, inv(vendor=""), inv()),
        (7, inv(vendor="x"), inv(vendor="x")),
    ]
    docs = spark.createDataFrame(rows, f"id long, pred struct<{gate.TYPED}>, gold struct<{gate.TYPED}>")
    ids = docs.where("pred is not null or gold is not null").groupBy("id").agg(F.bool_or(F.col("pred").isNull()).alias("pred_null"))
    slow, fast = extraction.field_scores(ids, extraction.compare_pairs(docs)), extraction.pair_scores(docs)
    assert sorted(fast.collect()) == sorted(slow.collect()) and fast.count() == 6
    plan = fast._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "Generate inline" not in plan


def test_lines_of_right_kinds_are_read_at_once(spark, monkeypatch):
    """Only lists whose lines have all fields, of the right kinds, are; and the gate says the same without that."""
    ok = '{"description":"a  b","qty":1,"unit_price":2.505,"total":1e2}'
    lists = {f"[{ok}]": True, f'[{ok},{{"description":" ","qty":0.5,"unit_price":-0.0,"total":7}}]': True, "[]": False, "{}": False, "null": False}
    lists |= {f"[{ok},{x}]": False for x in ("null", "4", "{}", "[]", ok.replace("1,", '"1 pc",'), ok.replace("1,", "true,"), ok.replace("1,", "null,"), ok.replace("1e2", '1,"x":1'), ok.replace('"a  b"', "1"), ok.replace('"qty":1,', ""))}
    head = '{"vendor":"V","date":"2024-01-02","currency":"USD","subtotal":1,"tax":2,"grand_total":"3","line_items":%s}'
    docs = spark.createDataFrame([(x, head % x) for x in lists], "list string, text string")
    told = lambda: {r.list: r.v for r in docs.select("list", gate.validate(F.col("text")).alias("v")).collect()}
    typed = docs.select("list", gate._typed_lines(F.try_parse_json("list")).isNotNull().alias("at_once"))
    assert {r.list: r.at_once for r in typed.collect()} == lists
    at_once = told()
    monkeypatch.setattr(gate, "_typed_lines", lambda listed: F.lit(None).cast(f"array<struct<{gate._of_line}>>"))
    assert told() == at_once and at_once[f"[{ok}]"].errors == []


@pytest.mark.parametrize("copies", [1, 2])
def test_labelling_reads_seeds_once(spark, tmp_path, copies):
    """Seeds are read once for all rounds, each request is called once (also where ids occur twice), and a run that was
    stopped calls for no id again whose piece of the log was committed."""
    (tmp_path / "read").mkdir()
    (tmp_path / "calls").mkdir()

    def read(batches):
        for batch in batches:
            for i in batch["id"]:
                with open(f"{tmp_path}/read/{i}", "a") as f:
                    f.write("x")
            yield batch.assign(text=[f"text {i}" for i in batch["id"]])

    def call(row):
        with open(f"{tmp_path}/calls/{row['id']}-{row['attempt']}", "a") as f:
            f.write("x")
        return f"no {row['id']}-{row['attempt']}"

    seeds = spark.range(40).select((F.col("id") % (40 // copies)).alias("id")).mapInPandas(read, "id long, text string")
    real, done = live.commit, []

    def dies(session, at, name):
        if len(done) == 5:  # in the second round
            raise RuntimeError("killed")
        done.append(name)
        real(session, at, name)

    live.commit = dies
    try:
        with pytest.raises(RuntimeError, match="killed"):
            live.labelled(seeds, call, f"file://{tmp_path}/live", "S", pieces=3)
    finally:
        live.commit = real
    if copies == 1:
        assert {p.read_text() for p in (tmp_path / "read").iterdir()} == {"x"}
    kept = {(r.id, r.attempt) for r in live.read_committed(spark, f"file://{tmp_path}/live/log", "id long, attempt long, reply string").collect()}
    log = live.labelled(seeds, call, f"file://{tmp_path}/live", "S", pieces=3)
    assert {(r.id, r.attempt, r.reply) for r in log.collect()} == {(i, a, f"no {i}-{a}") for i in range(40 // copies) for a in (1, 2, 3)}
    assert 40 // copies < len(kept) and all((tmp_path / "calls" / f"{i}-{a}").read_text() == "x" for i, a in kept)


def test_prose_is_not_parsed(spark):
    """What stands as JSON by its start and by the parser is what the parser alone takes for it."""
    texts = ["none", "null", "nullx", "true", "trueish", "false", "-1", "-x", "12", "1 2", '"a"', '"a', "{}", "{", '{"a":1} b', "[]", "[1,]", "n", "", "\u00e9", "Sure: {}", "+1", ".5", "NaN", "'a'", "null\nx"]
    row = spark.createDataFrame([(t,) for t in texts], "t string").select("t", gate._stands(F.col("t")).alias("a"), gate.is_json(F.col("t")).alias("b")).collect()
    assert [r.a for r in row] == [r.b for r in row] and {r.t for r in row if r.a} == {"null", "true", "false", "-1", "12", '"a"', "{}", "[]"}


@pytest.mark.parametrize("two", [False, True])
def test_candidates_travel_as_lists(spark, two):
    """Rows of a like size with many candidates make a few rows of lists, each id that has a pair is named once a group,
    and what comes out of them are the pairs that loops find, ids being strings."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    texts = {f"{i:03}": " ".join([*base[: i % 60], "other", *base[i % 60 + 1 :], f"w{i}"]) for i in range(240)}
    bits = similarity.with_bits(spark.createDataFrame(list(texts.items()), "id string, text string")).cache()
    right = bits if two else None
    met = similarity._met(bits, right, 0.9, similarity.BLOCK).collect()
    named = [(r.key, r.x, r.y, r.kind, r.id) for r in met if r.kind < 2]
    assert len(named) == len({*named})
    assert 0 < 5 * sum(r.kind == 2 for r in met) < sum(len(r.others) for r in met if r.kind == 2)
    sets = {i: _gram_set(t) for i, t in texts.items()}
    want = {(a, b) for a in sets for b in sets if (two or a < b) and _like(sets[a], sets[b]) >= 0.9}
    assert {(r.a, r.b) for r in similarity.similar_pairs(bits, right).collect()} == want
