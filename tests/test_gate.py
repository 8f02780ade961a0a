"""JSON extraction, the gate, files, prompts and calls."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import prompts
from millrace.operators import calls, extraction, gate
from millrace.sources import files

GOOD = {"vendor": " Acme  Co ", "date": "15 January 2024", "currency": "$", "line_items": [{"description": "a", "qty": "2 pcs", "unit_price": "1,50", "total": 3}], "subtotal": 3, "tax": 0, "grand_total": "3.00", "payment_terms": "N/A"}
LINE = GOOD["line_items"][0]


@pytest.fixture
def checked(spark):
    def run(outputs):
        rows = spark.createDataFrame([(i, o if o is None or isinstance(o, str) else json.dumps(o)) for i, o in enumerate(outputs)], "i int, output string")
        return [r for r in gate.schema_gate(rows).orderBy("i").collect()]

    return run


def test_gate_normalises(checked):
    got = checked([GOOD])[0]
    assert got._drop_reason is None
    assert json.loads(got.output) == {"vendor": "Acme Co", "date": "2024-01-15", "currency": "USD", "line_items": [{"description": "a", "qty": 2.0, "unit_price": 1.5, "total": 3.0}], "subtotal": 3.0, "tax": 0.0, "grand_total": 3.0, "payment_terms": None}
    assert list(json.loads(got.output)) == list(gate.FIELDS)


def test_gate_codes(checked):
    without = {k: v for k, v in GOOD.items() if k != "date"}
    cases = [
        (None, "not_json"), ("", "not_json"), ("{", "not_json"), (json.dumps(GOOD) + " x", "not_json"), (json.dumps(GOOD) + "}", "not_json"), ("[]", "not_object"), ("null", "not_object"), ("3", "not_object"),
        (without, "missing:date"), (GOOD | {"date": None}, "type:date"), (GOOD | {"tax": None}, "type:tax"), (GOOD | {"tax": True}, "type:tax"),
        (GOOD | {"tax": "none"}, "value:tax"), (GOOD | {"vendor": "  "}, "value:vendor"), (GOOD | {"vendor": 3}, "type:vendor"), (GOOD | {"note": 1, "b.c": 2}, "extra:b.c, extra:note"),
        (GOOD | {"line_items": []}, "empty:line_items"), (GOOD | {"line_items": "x"}, "type:line_items"), (GOOD | {"line_items": [LINE, 4]}, "type:line_items[1]"),
        (GOOD | {"line_items": [LINE | {"qty": "many", "x": 1}]}, "value:line_items[0].qty, extra:line_items[0].x"), (GOOD | {"payment_terms": 30}, "type:payment_terms"),
    ]
    got = checked([c for c, _ in cases])
    assert [r._drop_reason for r in got] == [f"schema: {want}" for _, want in cases]
    assert all(r.invoice is None for r in got)


def test_gate_without_rows_and_schema(spark, checked):
    assert checked([]) == []
    assert set(gate.json_schema()["required"]) == set(gate.FIELDS) - {"payment_terms"}
    assert gate.public(spark.range(1).select("id", F.lit(1).alias("_x"))).columns == ["id"]


def test_first_json(spark):
    cases = [("{\"a\": 1}", {"a": 1}), (" 12 ", 12), ("x ```json\n[1]\n``` {\"b\":2}", [1]), ("```\nsee {\"a\": \"}\"} ok\n```", {"a": "}"}), ("p {bad} q [1, 2] {\"c\": {\"d\": []}} r", {"c": {"d": []}}), ("p [1, [2]] q", [1, [2]]), ("none", None), ("", None), (None, None), ("{" * 500, None), ("{\"a\": \"\\\"{\"} tail", {"a": '"{'})]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    got = [r.j for r in rows.select("i", gate.first_json(F.col("x")).alias("j")).orderBy("i").collect()]
    assert [None if j is None else json.loads(j) for j in got] == [want for _, want in cases]


def test_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é\nx"), (2, None)], "id int, text string")
    files.write_jsonl(rows, str(tmp_path / "a"))
    assert "é" in "".join(p.read_text("utf-8") for p in (tmp_path / "a").glob("part-*"))
    assert sorted(files.read_jsonl(spark, str(tmp_path / "a"), "id int, text string").collect()) == sorted(rows.collect())
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n{"id": \n{"id": 2}\n')
    assert [(r.line, r.value) for r in files.bad_lines(spark, str(tmp_path / "b.jsonl")).collect()] == [(3, '{"id": ')]
    with pytest.raises(Exception, match="b.jsonl"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id int").collect()


def test_texts_sheets_and_settings(spark, tmp_path):
    for name, raw in (("a.txt", b"  one\xff \n"), ("b.txt", b" \n"), ("c.md", b"no")):
        (tmp_path / name).write_bytes(raw)
    assert [tuple(r) for r in files.read_texts(spark, str(tmp_path)).collect()] == [("a.txt", "one\ufffd")]
    sheet = spark.createDataFrame([("1", 'two\nlines, "quoted"', "OK"), ("2", None, "?"), ("", "x", "ok")], "id string, source_document string, label string")
    files.write_sheet(sheet, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True, multiLine=True, escape='"').columns == list(files.SHEET)
    got = {r.id: (r.label, r.raw_label) for r in files.read_ratings(spark, str(tmp_path / "s")).collect()}
    assert got == {"1": ("correct", "OK"), "2": (None, "?")}
    (tmp_path / "g.csv").write_text("id,label\n1,ok\n2,maybe\n1,wrong\n")
    assert [tuple(r) for r in files.read_settled(spark, str(tmp_path / "g.csv")).collect()] == [("1", "incorrect")]
    files.write_queue(spark.createDataFrame([("1", "x", "y")], "id string, a string, b string"), str(tmp_path / "q"))
    assert "1,x,y," in "".join(p.read_text() for p in (tmp_path / "q").glob("part-*"))
    (tmp_path / "c.json").write_text('{"a": {"b": 1, "c": 2}}')
    assert files.read_settings(tmp_path / "c.json", {"a": {"b": 3}})["a"] == {"b": 3, "c": 2}
    (tmp_path / "pyproject.toml").touch()
    assert files.read_settings(tmp_path / "c.json")["_root"] == str(tmp_path.resolve())
    assert files.project_root(tmp_path / "x") == tmp_path.resolve()


def test_attempts(spark):
    good = json.dumps(GOOD)
    log = spark.createDataFrame([(1, 1, "x"), (1, 2, good), (1, 3, "x"), (2, 1, "x"), (2, 2, "[]"), (2, 3, "{}"), (3, 4, good), (4, 1, "x")], "id int, attempt int, reply string")
    got = {r.id: (r.valid, r.attempts, r.reply) for r in calls.resolve(log).collect()}
    assert got == {1: (True, 2, good), 2: (False, 3, "{}"), 4: (False, 1, "x")}
    seeds = spark.createDataFrame([(i, "t") for i in (1, 2, 4, 5)], "id int, text string")
    asked = {r.id: r for r in calls.next_requests(seeds, log, "S").collect()}
    assert set(asked) == {4, 5} and (asked[4].attempt, asked[4].constrained, len(asked[4].messages)) == (2, True, 4)
    assert (asked[5].attempt, asked[5].temperature, len(asked[5].messages)) == (1, 0.0, 2)
    assert calls.two_passes(seeds).count() == 8


def test_attempts_that_never_end_well_raise(spark):
    log = spark.createDataFrame([(7, 1, "x"), (7, 2, "{}")], "id int, attempt int, reply string")
    with pytest.raises(Exception, match="no valid reply for 7 after 2"):
        calls.extracted(log).collect()


def test_passing_errors():
    class APIConnectionError(Exception):
        pass

    assert calls.passes(APIConnectionError("")) and calls.passes(ValueError("HTTP 503")) and calls.passes(TimeoutError())
    assert not calls.passes(ValueError("HTTP 429")) and not calls.passes(KeyError("x"))


def test_a_rewrite_reads_its_own_path(spark, tmp_path):
    at = f"file://{tmp_path}/rows"
    files.write_jsonl(spark.range(5), at)
    files.rewrite(files.read_jsonl(spark, at, "id long").withColumn("id", F.col("id") * 2), at)
    assert sorted(r.id for r in files.read_jsonl(spark, at, "id long").collect()) == [0, 2, 4, 6, 8]
    assert [p.name for p in tmp_path.iterdir()] == ["rows"]


def test_generation_stops_after_misses(spark):
    asked = []

    def ask(batch, want):
        asked.append((batch, want))
        return json.dumps(["a" * 50, "b" * 50]) if batch == 1 else "no"

    out = calls.until(spark, 5, ask, misses=3, per_call=4).collect()
    assert [len(r.text) for r in out] == [50, 50] and asked == [(0, 4), (1, 4), (2, 3), (3, 3)]


def test_calls_are_made_once_and_waited_for(spark):
    def call(row):
        if row["text"] == "bad":
            raise ValueError("refused")
        return row["text"].upper()

    asked = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "bad")], "key string, text string")
    assert {r.key: (r.reply, r.error) for r in calls.made(asked, call).collect()} == {"k1": ("A", None), "k2": (None, "refused")}
    with pytest.raises(ValueError, match="unknown provider"):
        calls.provider("nobody")
    assert len(spark.range(1).select(prompts.call_key(model=F.lit("m")).alias("k")).first().k) == 40


def test_plain_texts_are_read_as_others_are(spark):
    """What is read by its schema against the same value with a space, which is taken apart by its values."""
    line = '{"description":"a  b","qty":2.0,"unit_price":1.255,"total":2.51}'
    head = '"vendor":" A","date":"2024-01-05","currency":"eur"'
    tail = '"subtotal":2.5,"tax":-0.0,"grand_total":1.0E10'
    texts = [f'{{{head},"line_items":[{lines}],{tail}{end}}}' for lines in (line, f"{line},{line}", "", f"null,{line}", '{"qty":1.0}', line.replace("a  b", " ")) for end in ("", ',"payment_terms":null', ',"payment_terms":"Net 30"', ',"payment_terms":"none"')]
    texts += [texts[0].replace("2024-01-05", "soon"), texts[0].replace(" A", ""), texts[0].replace("-0.0", '"NaN"'), texts[0].replace("-0.0", "null"), texts[0].replace("eur", "12"), "{}", "[]"]
    rows = spark.createDataFrame([(i, t, t[0] + " " + t[1:]) for i, t in enumerate(texts)], "id long, text string, spaced string")
    told = lambda c: [gate.validate(F.col(c)).alias(f"v_{c}"), extraction.json_fields(F.col(c)).alias(f"f_{c}")]
    got = rows.select("id", *told("text"), *told("spaced"), gate.plain(F.col("text")).isNotNull().alias("plain"), gate.plain(F.col("spaced")).isNull().alias("general")).collect()
    assert all(repr((r.v_text, r.f_text)) == repr((r.v_spaced, r.f_spaced)) and r.general for r in got)  # repr: one number is NaN
    assert sum(r.plain for r in got) > len(texts) // 2


def test_fields_are_computed_once(spark):
    """The plan doesn't filter a generator's rows by what the generator itself computes."""
    rows = spark.createDataFrame([(1, '{"tax":1}')], "id long, raw string").withColumn("pred", F.from_json("raw", gate.TYPED))
    for df in (extraction.flatten_json(rows, "raw"), extraction.compare_pairs(rows.select("id", "pred", F.col("pred").alias("gold"))), extraction.compare_records(extraction.records(rows, "raw"), extraction.records(rows, "raw"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.split("\n") if "Filter" in x and "size(" in x]


def test_raw_fields_are_read_by_compiled_code(spark):
    """Rows of fields are those that json_fields() tells, no value is read within a lambda, and no filter on what was read
    is pushed below it, where all values would be read once more (F6, F9)."""
    texts = ['{"vendor":null,"tax":"1d","line_items":[4,null,{"qty":"2"},{"total":[1],"qty":null}]}', '{"tax":-0.0,"grand_total":true,"vendor":{"b":1,"a":[]},"line_items":{}}', '{"payment_terms":3,"subtotal":" 12.5 ","line_items":[]}', "[1]", "x", "null", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, raw string")
    got = extraction.flatten_json(rows, "raw")
    want = rows.select("id", F.inline(extraction.json_fields(F.col("raw"))))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.columns == want.columns
    wrong = extraction.categorise(extraction.compare_records(extraction.records(rows, "raw"), extraction.records(rows, "raw"))).where("category is not null")
    for df in (got, wrong):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.split("\n") if "Generate inline" in x and "lambda" in x]
        assert not [x for x in plan.split("\n") if "Filter" in x and "CASE WHEN" in x.split("Filter", 1)[1] and "static_invoke" in x.lower()]
