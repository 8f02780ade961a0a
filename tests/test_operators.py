"""Operators against plain loops and invariants."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import queries as Q
from millrace.operators import cost, extraction, reports, review, similarity

CHECKED = sorted(Q.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: repr(round(float(x), 9) + 0.0) if isinstance(x, float) or hasattr(x, "is_finite") else str(x)
    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, sf_dir, duck, name):
    df = Q.QUERIES[name](spark, sf_dir)
    want = duck.sql(Q.ORACLE_SQL[name])
    assert _rows(df.collect(), df.columns) == _rows(want.fetchall(), want.columns)


def _grams(text):
    s = " ".join(text.lower().split())
    return {s[i : i + 3] for i in range(len(s) - 2)} if len(s) >= 3 else ({s} if s else set())


def test_pairs_and_greedy_against_loops(spark):
    rows = Q.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows} | {1000: "", 1001: " ", 1002: "ab", 1003: "AB", 1004: "xy😀z", 1005: None}
    grams = {d: _grams(t or "") for d, t in texts.items()}
    order = sorted(texts)
    sim = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b]) if grams[a] and grams[b] else 0.0
    pairs = {(a, b) for a in order for b in order if a < b and sim(a, b) >= 0.9}
    kept, dup = [], {}
    for d in order:
        near = [k for k in kept if sim(k, d) >= 0.9]
        if near:
            dup[d] = max(near, key=lambda k: (sim(k, d), -k))
        else:
            kept.append(d)
    bits = similarity.classed(spark.createDataFrame(list(texts.items()), "id long, text string"))
    found = similarity.similar_pairs(bits)
    assert {(r.a, r.b) for r in found.collect()} == pairs
    out = similarity.greedy(bits.select("id"), found).collect()
    assert {r.id for r in out if r.kept} == set(kept)
    assert {r.id: r.dup_of for r in out if not r.kept} == dup
    whole = similarity.dedup(bits).collect()
    assert sorted(r.id for r in whole) == order
    assert {r.id: r.dup_of for r in whole if not r.kept} == dup
    first = {}
    for d in order:
        first.setdefault(frozenset(grams[d]), d)
    rep = {d: first[frozenset(grams[d])] for d in order}
    classed = {(a, b) for a, b in pairs if rep[a] == a and rep[b] == b} | {(rep[d], d) for d in order if rep[d] != d and grams[d]}
    assert {(r.a, r.b) for r in similarity.class_pairs(bits).collect()} == classed


def test_copies_and_leaks_against_loops(spark):
    long = "the quick brown fox jumps over the lazy dog and runs on"
    texts = {1: long, 2: long + "s x", 3: long + "s", 4: long.upper(), 5: long + "s", 6: "", 7: None, 8: "ab", 9: "ab", 10: "else"}
    for spread in (range(1, 11), (3, 1, 4, 2, 5, 7, 6, 9, 8, 10)):
        mine = dict(zip(spread, texts.values(), strict=True))
        grams = {d: _grams(t or "") for d, t in mine.items()}
        sim = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b]) if grams[a] and grams[b] else 0.0
        kept, dup = [], {}
        for d in sorted(mine):
            near = [k for k in kept if sim(k, d) >= 0.95]
            if near:
                dup[d] = max(near, key=lambda k: (sim(k, d), -k))
            else:
                kept.append(d)
        docs = spark.createDataFrame(list(mine.items()), "id long, text string")
        out = similarity.dedup_texts(docs, threshold=0.95).collect()
        assert {r.id: r.dup_of for r in out if not r.kept} == dup and len(out) == 10
    bits = similarity.classed(docs)
    other = spark.createDataFrame([(1, "ab"), (2, ""), (3, " "), (4, "AB"), (5, "none of them")], "id long, text string")
    found = similarity.leaks(bits, similarity.classed(other)).collect()
    assert {(r.a, r.b) for r in found} == {(d, 1) for d, t in mine.items() if t == "ab"} | {(d, 2) for d, t in mine.items() if not t}
    for wrong in ("none", "embedding"):
        with pytest.raises(ValueError):
            similarity.dedup_texts(docs, wrong)


def test_greedy_keeps_what_is_only_near_a_dropped_row(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.95), (3, 4, 0.92)], "a long, b long, similarity double")
    out = {r.id: (r.kept, r.dup_of) for r in similarity.greedy(spark.range(1, 6), pairs).collect()}
    assert out == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (False, 3), 5: (True, None)}


@pytest.mark.parametrize("at_once", [0, 50, 10**6])
def test_greedy_settles_long_chains(spark, at_once):
    """Each row is near the one before it alone: every second one stays, however many there are."""
    n = 20 if at_once < 50 else 400 if at_once > 50 else 60
    pairs = spark.createDataFrame([(i, i + 1, 0.95) for i in range(n)], "a long, b long, similarity double")
    assert {r.id for r in similarity.greedy(spark.range(n + 1), pairs, at_once).collect() if r.kept} == set(range(0, n + 1, 2))


def test_grams_of_characters_beyond_the_plane(spark):
    texts = ["a😀b c", "😀😀😀😀", "😀", "ab", "Straße  X", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = [_grams(t or "") for t in texts]
    assert [set(r.g) for r in rows.select("id", similarity.grams(F.col("text")).alias("g")).orderBy("id").collect()] == want
    assert [r.n for r in similarity.with_bits(rows).orderBy("id").collect()] == [len(g) for g in want]


def test_allocation_sums_up(spark):
    sizes = [("a", 5), ("b", 50), ("c", 1), ("d", 33)]
    strata = spark.createDataFrame(sizes, "stratum string, size long")
    for n in (0, 1, 7, 40, 200):
        got = {r.stratum: r.alloc for r in review.allocate(strata, n).collect()}
        assert sum(got.values()) == min(n, 89) and all(got[s] <= k for s, k in sizes)


@pytest.mark.parametrize("pairs,kappa", [([("x", "x")] * 5, 1.0), ([("x", "y"), ("y", "x")] * 5, -1.0), ([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15, 0.4)])
def test_kappa(spark, pairs, kappa):
    out = review.rater_scores(spark.createDataFrame(pairs, "a string, b string")).first()
    assert math.isclose(out.kappa, kappa, abs_tol=1e-9)


def test_field_counts_add_up(spark, sf_dir):
    scores = Q.field_scores(spark, "/root/testdata/sf0.001")
    pred = Q.flatten_pred(spark, "/root/testdata/sf0.001").groupBy("id").agg(F.count("*").alias("p"))
    gold = Q.flatten_gold(spark, "/root/testdata/sf0.001").groupBy("id").agg(F.count("*").alias("g"))
    bad = scores.join(pred, "id", "left").join(gold, "id", "left").where("tp + fp <> coalesce(p, 0) or tp + fn <> coalesce(g, 0)")
    assert bad.count() == 0


def test_price_modes(spark):
    calls = spark.createDataFrame([("big-2024", 1), ("big", 2), ("bi", 3), ("other", 4), (None, 5)], "model string, n int")
    table = spark.createDataFrame([("big-", 1, 1.0, 2.0), ("big", 2, 3.0, 4.0)], "prefix string, ord int, price_in double, price_out double")
    got = lambda **k: [r.price_in for r in cost.prices(calls, table, **k).orderBy("n").collect()]
    assert got() == [1.0, 3.0, 1.0, 0.0, 0.0]
    assert got(mode="prefix", default=(9, 9)) == [1.0, 3.0, 9.0, 9.0, 9.0]
    assert got(mode="exact") == [3.0, 3.0, 3.0, 3.0, 3.0]
    with pytest.raises(Exception, match="no price for model"):
        got(mode="prefix")
    with pytest.raises(ValueError):
        got(mode="none")


def test_volume_axis():
    assert list(cost.volume_axis(3)) == list(range(12))[:11] and list(cost.volume_axis(600))[-1] == 600
    assert cost.volume_axis(1234).step == 20 and cost.volume_axis(1234)[-1] >= 1234


def test_report_without_figures(spark):
    row = spark.createDataFrame([(None, None, False, 1234.5, None, None, None)], "f1_macro double, ratio double, meets_bar boolean, api_1k double, own_1k double, multiple double, break_even double")
    out = reports.money_table(row).orderBy("ord").collect()
    assert [out[0].teacher, out[0].student, out[1].student, out[7].student] == ["$1,234.50", "n/a", "n/a", "none"]
    text = reports.markdown(reports.money_table(row)).first().text.split("\n")
    assert text[0] == "| metric | teacher | student | win |" and len(text) == 10


def test_break_even(spark):
    m = reports.Machine()
    got = spark.range(1).select(m.break_even(F.lit(0.00795), F.lit(4.0)).alias("x"), m.break_even(F.lit(0.0), F.lit(4.0)).alias("none")).first()
    assert abs(got.x - 126.4) < 0.05 and got.none is None


def test_gold_and_raters_without_rows_are_errors(spark):
    none = spark.createDataFrame([], "label string")
    with pytest.raises(Exception, match="no gold labels"):
        review.human_accuracy(none).collect()
    a = spark.createDataFrame([(1, "correct", 1)], "id long, label string, ord int")
    with pytest.raises(Exception, match="share no rated item"):
        review.score_raters(a, a.withColumn("id", F.col("id") + 1)).collect()
    with pytest.raises(Exception, match="no documents to score"):
        extraction.batch_scores(spark.createDataFrame([], "tp long, fp long, fn long, f1 double, precision double, recall double, exact boolean, agreement double")).collect()


def test_pairs_by_place(spark):
    side = lambda rows, name: spark.createDataFrame(rows, f"at long, {name} string")
    assert [tuple(r) for r in extraction.one_to_one(side([(1, "x"), (2, None)], "pred"), side([(2, "b"), (1, "a")], "gold")).orderBy("at").collect()] == [(1, "x", "a"), (2, None, "b")]
    for preds, golds in (([(1, "x")], [(1, "a"), (2, "b")]), ([(1, "x"), (1, "y")], [(1, "a")])):
        with pytest.raises(Exception, match="no pair at place"):
            extraction.one_to_one(side(preds, "pred"), side(golds, "gold")).collect()
    with pytest.raises(ValueError):
        extraction.one_to_one(side([], "pred"), side([], "gold"))


_INVOICE = "struct<vendor: string, date: string, currency: string, line_items: array<struct<description: string, qty: double, unit_price: double, total: double>>, subtotal: double, tax: double, grand_total: double, payment_terms: string>"


def test_fields_within_a_row_and_by_a_join_agree(spark):
    """Null lines keep their numbers; sides may be null or of different lengths."""
    line = lambda d: (d, 1.0, 2.0, 2.0)
    one = lambda *lines: ("V", "2024-01-01", "USD", list(lines), 1.0, 0.0, 1.0, None)
    rows = [(1, one(line("a"), None, line("b")), one(line("A "), line("x"))), (2, None, one(line("a"))), (3, one(), None), (4, one(None), one(None)), (5, None, None)]
    docs = spark.createDataFrame(rows, f"id long, pred {_INVOICE}, gold {_INVOICE}")
    columns = ["id", "path", "leaf", "has_pred", "has_gold", "same", "match", "ps", "pn", "gs", "gn"]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    joined = extraction.compare(extraction.flatten(docs, "pred"), extraction.flatten(docs, "gold"))
    within = extraction.compare_pairs(docs)
    assert key(within) == key(joined)
    paths = {r.path for r in within.where("id = 1 and has_pred and path like 'line%description'").collect()}
    assert paths == {"line_items[0].description", "line_items[2].description"}


def test_json_fields(spark):
    text = '{"vendor": null, "tax": "3.50", "subtotal": true, "date": 5, "currency": {"a": [1]}, "other": 1, "line_items": [null, 3, {"qty": "2", "total": "x"}, []]}'
    rows = extraction.flatten_json(spark.createDataFrame([(1, text), (2, "[]"), (3, None), (4, '{"line_items": "no"}')], "id long, j0 string"), "j0").collect()
    got = {r.path: (r.s, r.n, r.j) for r in rows}
    assert got == {"vendor": (None, None, None), "tax": (None, 3.5, None), "subtotal": (None, 1.0, None), "date": (None, 5.0, None), "currency": (None, None, '{"a":[1]}'), "line_items[2].qty": (None, 2.0, None), "line_items[2].total": ("x", None, None)}
    assert {r.id for r in rows} == {1}


def test_repeated_second_passes_do_not_multiply_records(spark):
    docs = spark.createDataFrame([(1, ("V", "d", "USD", [], 1.0, 0.0, 1.0, None)), (2, ("V", "d", "USD", [], 1.0, 0.0, 1.0, None))], f"id long, output {_INVOICE}")
    bad = ("W", "e", "EUR", [], 9.0, 9.0, 9.0, "x")
    good = ("V", "d", "USD", [], 1.0, 0.0, 1.0, None)
    second = spark.createDataFrame([(1, 1, good), (1, 2, bad), (2, 1, bad), (2, 2, None)], f"id long, ord int, output {_INVOICE}")
    got = {r.id: (r.agreement, r.kept, r.reason) for r in extraction.consistency_of(docs, second).collect()}
    assert got == {1: (0.0, False, "consistency: 0.000"), 2: (None, True, None)}
    old = extraction.consistency(spark.createDataFrame([(1, 0.5)], "id long, agreement double"), spark.createDataFrame([(1, False), (1, True)], "id long, null_second boolean"))
    assert [tuple(r) for r in old.collect()] == [(1, 0.5, False, "consistency: 0.500")]


def test_cost_parameters_out_of_range(spark):
    good = {"capex": 1100.0, "years": 3.0, "utilisation": 1.0, "watts": 360.0, "per_kwh": 0.15}
    assert cost.amortised_hourly(**good) == pytest.approx(1100 / (3 * 365 * 24) + 0.36 * 0.15)
    for name, value in (("capex", -1.0), ("watts", -1.0), ("per_kwh", -0.1), ("years", 0.0), ("years", -3.0), ("utilisation", 0.0), ("utilisation", 1.1)):
        with pytest.raises(ValueError, match="out of range"):
            cost.amortised_hourly(**good | {name: value})
    assert spark.range(1).select(cost.api_cost(F.lit(900), F.lit(350), F.lit(3.0), F.lit(15.0)).alias("c")).first().c == pytest.approx(0.00795)
    for args in ((-1, 1, 1.0, 1.0), (1, -1, 1.0, 1.0), (1, 1, -1.0, 1.0), (1, 1, 1.0, -1.0)):
        with pytest.raises(Exception, match="negative"):
            spark.range(1).select(cost.api_cost(*map(F.lit, args))).collect()
