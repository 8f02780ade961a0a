"""Registry of the library's queries and their oracle SQL."""

from __future__ import annotations

import json
import random
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import normalise, prompts
from millrace.operators import calls, cost, extraction, gate, live, reports, review, similarity
from millrace.plans.invoices import COMPARED, SQL, cents, gold, predicted, table
from millrace.sources import files
from millrace.sources.scratch import keep, new_path
from millrace.streaming import incremental

FLAGSHIP = "field_scores"
QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: Places of doubles that aggregates are rounded to, so that the order of summing doesn't show.
PLACES = 9


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(*columns: str):
    return [F.round(c, PLACES).alias(c) for c in columns]


def _invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(gold(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.pair_scores(_invoices(spark, sf_dir))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.categorise(extraction.compare_pairs(_invoices(spark, sf_dir)))


@query(SQL + " SELECT id, path, leaf, s, n FROM gold_f")
def flatten_gold(spark, sf_dir):
    return extraction.flatten(gold(spark, sf_dir), "gold")


@query(SQL + " SELECT id, path, leaf, s, round(n, 9) AS n FROM pred_f")
def flatten_pred(spark, sf_dir):
    return extraction.flatten(predicted(gold(spark, sf_dir)), "pred").withColumn("n", F.round("n", PLACES))


@query(COMPARED + " SELECT id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, exact, round(agreement, 9) AS agreement FROM sc")
def field_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("id", "tp", "fp", "fn", *_r("precision", "recall", "f1"), "exact", *_r("agreement"))


@query(COMPARED + """ SELECT count(*) AS n, round(avg(f1), 9) AS f1_macro, round(avg(p), 9) AS precision_macro, round(avg(r), 9) AS recall_macro,
  round(2.0 * (CAST(sum(tp) AS DOUBLE) / sum(tp + fp)) * (CAST(sum(tp) AS DOUBLE) / sum(tp + fn)) / (CAST(sum(tp) AS DOUBLE) / sum(tp + fp) + CAST(sum(tp) AS DOUBLE) / sum(tp + fn)), 9) AS f1_micro,
  round(avg(CAST(exact AS INT)), 9) AS exact_rate, round(avg(agreement), 9) AS agreement, round(avg(CASE WHEN id % 9 = 5 THEN 1 ELSE 0 END), 9) AS schema_valid_rate FROM sc""")
def evaluate_batch(spark, sf_dir):
    valid = F.size(gate.validate(F.col("raw"))["errors"]) == 0
    docs = _replied(spark, sf_dir).withColumn("valid", valid)
    out = extraction.batch_scores(extraction.pair_scores(docs, keep=("valid",)), F.col("valid"))
    return out.select("n", *_r("f1_macro", "precision_macro", "recall_macro", "f1_micro", "exact_rate", "agreement", "schema_valid_rate"))


_CATEGORY = """, cat AS (SELECT *, CASE WHEN same THEN NULL WHEN ps IS NULL AND pn IS NULL THEN CASE WHEN path LIKE 'line_items[%' THEN 'missing_line_item' ELSE 'missing_field' END
  WHEN gs IS NULL AND gn IS NULL THEN CASE WHEN path LIKE 'line_items[%' THEN 'hallucinated_line_item' ELSE 'hallucinated_field' END
  WHEN leaf IN ('unit_price','total','subtotal','tax','grand_total') THEN 'wrong_money' WHEN leaf = 'qty' THEN 'wrong_qty' WHEN leaf = 'date' THEN 'wrong_date' ELSE 'wrong_text' END AS category FROM cmp) """


@query(COMPARED + _CATEGORY + "SELECT category, count(*) AS n FROM cat WHERE category IS NOT NULL GROUP BY 1")
def error_categories(spark, sf_dir):
    return _fields(spark, sf_dir).where("category is not null").groupBy("category").agg(F.count("*").alias("n"))


@query(COMPARED + _CATEGORY + "SELECT leaf, count(*) AS n FROM cat WHERE category IS NOT NULL GROUP BY 1")
def error_leaves(spark, sf_dir):
    return _fields(spark, sf_dir).where("category is not null").groupBy("leaf").agg(F.count("*").alias("n"))


@query(COMPARED + _CATEGORY + "SELECT id, count(*) AS n_fields, count(category) AS n_errors FROM cat GROUP BY 1 HAVING count(category) > 0 ORDER BY n_errors DESC, id LIMIT 5")
def worst_documents(spark, sf_dir):
    by = _fields(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n_fields"), F.count("category").alias("n_errors"))
    return by.where("n_errors > 0").orderBy(F.desc("n_errors"), "id").limit(5)


_SECOND = "id % 10 > 1 AND id % 29 <> 0"


def _second(spark, sf_dir):
    """Second passes: the damaged copy; absent where id % 10 = 0, null where 1; a third has an earlier one, the gold."""
    both = _invoices(spark, sf_dir).where("id % 10 <> 0")
    passes = F.array(F.struct(F.lit(1).alias("ord"), F.col("gold").alias("output")), F.struct(F.lit(2).alias("ord"), F.when(F.col("id") % 10 != 1, F.col("pred")).alias("output")))
    return both.select("id", F.inline(F.when(F.col("id") % 3 == 0, passes).otherwise(F.slice(passes, 2, 1))))


@query(COMPARED + f""" SELECT id, CASE WHEN {_SECOND} THEN round(agreement, 4) END AS agreement, NOT ({_SECOND}) OR agreement >= 0.85 AS kept,
  CASE WHEN {_SECOND} AND agreement < 0.85 THEN 'consistency: ' || printf('%.3f', agreement) END AS reason FROM sc""")
def consistency_filter(spark, sf_dir):
    return extraction.consistency_of(gold(spark, sf_dir).withColumnRenamed("gold", "output"), _second(spark, sf_dir))


@query(COMPARED + f" SELECT id, {_SECOND} AND agreement >= 0.85 AS ok, CASE WHEN {_SECOND} THEN round(agreement, 9) ELSE 0.0 END AS agreement FROM sc")
def self_consistency(spark, sf_dir):
    met = extraction.second_pass(gold(spark, sf_dir).withColumnRenamed("gold", "output"), _second(spark, sf_dir))
    scores = extraction.pair_scores(met.withColumn("seen", F.col("second").isNotNull()), "second", "output", ("seen",))
    return scores.select("id", extraction.self_consistent(F.when(F.col("seen"), F.col("agreement"))).alias("x")).select("id", "x.ok", F.round("x.agreement", PLACES).alias("agreement"))


@query(SQL + """ SELECT h.id, h.subtotal, abs(coalesce(t.total, 0) - h.subtotal) <= CAST(0.01 AS DOUBLE) AS lines, h.id % 5 <> 3 AS total FROM h JOIN ph ON ph.id = h.id
  LEFT JOIN (SELECT id, sum(total) AS total FROM pl GROUP BY 1) t ON t.id = h.id""")
def arithmetic_check(spark, sf_dir):
    """Of damaged invoices; by a grand total that is 0.02 off, or lines that don't make the subtotal."""
    x = _invoices(spark, sf_dir).where("pred is not null").select("id", F.col("pred.subtotal").alias("subtotal"), extraction.sums_up(F.col("pred"), 0.01).alias("x"))
    return x.select("id", "subtotal", "x.lines", "x.total")


@query(SQL + """, t AS (SELECT id, count(*) AS lines, sum(total) AS total FROM pl GROUP BY 1)
  SELECT ids.id, CASE WHEN pred_null THEN 'no_invoice' ELSE concat_ws(',', CASE WHEN t.lines > 5 THEN 'many_lines' END, CASE WHEN abs(coalesce(t.total, 0) + ph.tax - ph.grand_total) > CAST(0.03 AS DOUBLE) THEN 'arithmetic' END,
    CASE WHEN ids.id % 8 = 3 THEN 'missing:date' END, CASE WHEN ids.id % 31 = 5 THEN 'missing:currency' END) END AS reasons FROM ids LEFT JOIN ph ON ph.id = ids.id LEFT JOIN t ON t.id = ids.id""")
def routing(spark, sf_dir):
    p = F.col("pred")
    bare = p.withField("date", F.when(F.col("id") % 8 != 3, p["date"])).withField("currency", F.when(F.col("id") % 31 != 5, p["currency"]))
    rows = _invoices(spark, sf_dir).withColumn("x", F.when(p.isNotNull(), bare))
    return rows.select("id", F.array_join(extraction.route(F.col("x"), 5, 0.03), ",").alias("reasons"))


#: Invoices as JSON text, damaged on the way: keys of null fields dropped, lines that aren't objects, an amount as text, an
#: object for a name, and an array in place of an object. raw_f has the fields that remain.
_RAW = SQL + """, raw_f AS (SELECT id, CASE WHEN id % 5 = 0 AND path LIKE 'line_items[%' THEN 'line_items[' || (CAST(regexp_extract(path, '\\[([0-9]+)\\]', 1) AS BIGINT) + 2) || '].' || leaf ELSE path END AS path, leaf,
  CASE WHEN NOT (id % 13 = 6 AND path = 'vendor') THEN s END AS s, CASE WHEN id % 11 = 4 AND path = 'tax' THEN 12.5 ELSE n END AS n, CASE WHEN id % 13 = 6 AND path = 'vendor' THEN '{"n":1}' END AS j
  FROM gold_f WHERE id % 17 <> 8 AND NOT (id % 7 = 3 AND path = 'date') AND NOT (id % 2 = 0 AND s IS NULL AND n IS NULL))"""


def _raw(spark, sf_dir):
    k, g = F.col("id"), F.col("gold")
    j = F.when(k % 2 == 0, F.to_json(g)).otherwise(F.to_json(g, {"ignoreNullFields": "false"}))
    for when, pattern, to in ((k % 5 == 0, r'"line_items":\[', '"line_items":[4,"x",'), (k % 7 == 3, '"date":"[^"]*",', ""), (k % 11 == 4, '"tax":[^,}]*', '"tax":" 12.5 "'), (k % 13 == 6, '"vendor":"[^"]*"', '"vendor":{"n":1}')):
        j = F.when(when, F.regexp_replace(j, pattern, to)).otherwise(j)
    return gold(spark, sf_dir).select("id", "gold", F.when(k % 17 == 8, "[1]").otherwise(j).alias("raw"))


@query(_RAW + " SELECT id, path, leaf, s, round(n, 9) AS n, j FROM raw_f")
def flatten_raw(spark, sf_dir):
    return extraction.flatten_json(_raw(spark, sf_dir), "raw").withColumn("n", F.round("n", PLACES))


@query(_RAW + """, c AS (SELECT coalesce(p.id, g.id) AS id, p.id IS NOT NULL AS hp, g.id IS NOT NULL AS hg, CASE WHEN p.s IS NULL AND p.n IS NULL AND p.j IS NULL THEN g.s IS NULL AND g.n IS NULL WHEN g.s IS NULL AND g.n IS NULL THEN false
    WHEN p.n IS NOT NULL AND g.n IS NOT NULL THEN abs(p.n - g.n) <= CASE WHEN g.leaf = 'qty' THEN CAST(0.0001 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END
    ELSE coalesce(lower(trim(regexp_replace(p.s, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(g.s, '\\s+', ' ', 'g'))), false) END AS same FROM raw_f p FULL OUTER JOIN gold_f g ON p.id = g.id AND p.path = g.path)
  SELECT id, count(*) FILTER (same AND hp AND hg) AS tp, count(*) FILTER (hp AND NOT (same AND hg)) AS fp, count(*) FILTER (hg AND NOT (same AND hp)) AS fn FROM c GROUP BY 1""")
def raw_scores(spark, sf_dir):
    """Raw replies against the invoices, as tables apart: what is missing differs from what is null."""
    rows = keep(_raw(spark, sf_dir), "raw")
    told = rows.select("id", F.to_json("gold", {"ignoreNullFields": "false"}).alias("whole"))
    fields = extraction.compare_records(extraction.records(rows, "raw"), extraction.records(told, "whole"))
    return extraction.field_scores(rows.select("id", (F.col("id") % 17 == 8).alias("pred_null")), fields).select("id", "tp", "fp", "fn")


#: Values on both sides that no number can be read from, one that a cast would read, and a list.
_ODD = ((19, 2, "tax", '"n/a"', '"n/a"'), (23, 3, "grand_total", "[1]", "[1]"), (29, 4, "tax", '"1d"', "1.0"))


def _odd(j, k, side):
    for by, rest, name, *to in _ODD:
        j = F.when(k % by == rest, F.regexp_replace(j, f'"{name}":("[^"]*"|[^,}}]*)', f'"{name}":{to[side]}')).otherwise(j)
    return j


@query(_RAW + """, p AS (SELECT id, path, leaf, CASE WHEN path = 'tax' AND id % 29 = 4 THEN '1d' WHEN path = 'tax' AND id % 19 = 2 THEN 'n/a' ELSE s END AS s, CASE WHEN path = 'tax' AND (id % 29 = 4 OR id % 19 = 2) OR path = 'grand_total' AND id % 23 = 3 THEN NULL ELSE n END AS n, CASE WHEN path = 'grand_total' AND id % 23 = 3 THEN '[1]' ELSE j END AS j FROM raw_f),
  g AS (SELECT id, path, leaf, CASE WHEN path = 'tax' AND id % 29 <> 4 AND id % 19 = 2 THEN 'n/a' ELSE s END AS s, CASE WHEN path = 'tax' AND id % 29 = 4 THEN CAST(1 AS DOUBLE) WHEN path = 'tax' AND id % 19 = 2 OR path = 'grand_total' AND id % 23 = 3 THEN NULL ELSE n END AS n, CASE WHEN path = 'grand_total' AND id % 23 = 3 THEN '[1]' END AS j FROM gold_f),
  c AS (SELECT coalesce(p.id, g.id) AS id, coalesce(p.path, g.path) AS path, coalesce(p.leaf, g.leaf) AS leaf, p.s IS NULL AND p.n IS NULL AND p.j IS NULL AS np, g.s IS NULL AND g.n IS NULL AND g.j IS NULL AS ng, abs(p.n - g.n) AS apart, p.s AS ps, g.s AS gs, p.j = g.j AS nested FROM p FULL OUTER JOIN g ON p.id = g.id AND p.path = g.path),
  m AS (SELECT *, CASE WHEN np AND ng THEN true WHEN np OR ng THEN false WHEN leaf = 'qty' THEN coalesce(apart <= CAST(0.0001 AS DOUBLE), false) WHEN leaf IN ('unit_price', 'total', 'subtotal', 'tax', 'grand_total') THEN coalesce(apart <= CAST(0.01 AS DOUBLE), false)
    ELSE coalesce(lower(trim(regexp_replace(ps, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(gs, '\\s+', ' ', 'g'))), nested, false) END AS same FROM c)
  SELECT id, path, CASE WHEN np THEN 'missing' WHEN ng THEN 'hallucinated' WHEN leaf IN ('unit_price', 'total', 'subtotal', 'tax', 'grand_total') THEN 'wrong_money' WHEN leaf = 'qty' THEN 'wrong_qty' WHEN leaf = 'date' THEN 'wrong_date' ELSE 'wrong_text' END || CASE WHEN np OR ng THEN CASE WHEN path LIKE 'line_items[%' THEN '_line_item' ELSE '_field' END ELSE '' END AS category FROM m WHERE NOT same""")
def raw_categories(spark, sf_dir):
    """The error taxonomy over raw JSON on both sides: nested values, amounts that are no numbers, fields that are missing."""
    k = F.col("id")
    rows = keep(_raw(spark, sf_dir).select("id", _odd(F.col("raw"), k, 0).alias("raw"), _odd(F.to_json("gold", {"ignoreNullFields": "false"}), k, 1).alias("whole")), "raw")
    fields = extraction.compare_records(extraction.records(rows, "raw"), extraction.records(rows, "whole"))
    return extraction.categorise(fields).where("category is not null").select("id", "path", "category")


@query(SQL + " SELECT id - 1 AS at, id % 29 = 0 AS pred_null, vendor FROM h")
def one_to_one(spark, sf_dir):
    both = _invoices(spark, sf_dir).withColumn("at", F.col("id") - 1)
    met = extraction.one_to_one(both.select("at", "pred"), both.select("at", "gold"))
    return met.select("at", F.col("pred").isNull().alias("pred_null"), "gold.vendor")


@query(COMPARED + _CATEGORY + "SELECT category, n, row_number() OVER (ORDER BY n DESC, category) AS rank FROM (SELECT category, count(*) AS n FROM cat WHERE category IS NOT NULL GROUP BY 1) x")
def categories_ranked(spark, sf_dir):
    return extraction.most_common(_fields(spark, sf_dir).where("category is not null"), "category")


@query(COMPARED + _CATEGORY + """, d AS (SELECT id, count(*) AS f, count(category) AS e FROM cat GROUP BY 1)
  SELECT count(*) AS n_docs, count(*) FILTER (e = 0) AS n_perfect, CAST(sum(f) AS BIGINT) AS n_fields, CAST(sum(e) AS BIGINT) AS n_errors, round(sum(e) / sum(f), 9) AS error_share,
  (SELECT string_agg(category || '=' || n, ',' ORDER BY n DESC, category) FROM (SELECT category, count(*) AS n FROM cat WHERE category IS NOT NULL GROUP BY 1) x) AS categories,
  (SELECT string_agg(leaf || '=' || n, ',' ORDER BY n DESC, leaf) FROM (SELECT leaf, count(*) AS n FROM cat WHERE category IS NOT NULL GROUP BY 1) x) AS leaves,
  (SELECT string_agg(id, ',' ORDER BY e DESC, id) FROM (SELECT id, e FROM d WHERE e > 0 ORDER BY e DESC, id LIMIT 5) x) AS worst FROM d""")
def failure_report(spark, sf_dir):
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["name"], x["n"].cast("string"))), ",").alias(c)
    out = reports.failures(keep(_fields(spark, sf_dir).select("id", "path", "leaf", "category"), "fields"))
    return out.select("n_docs", "n_perfect", "n_fields", "n_errors", *_r("error_share"), told("categories"), told("leaves"), F.array_join(F.transform("worst", lambda x: x["id"].cast("string")), ",").alias("worst"))


_ITEMS = COMPARED + """, items AS (SELECT sc.id, CASE WHEN sc.id % 29 <> 0 AND sc.id % 19 = 6 THEN 'XXX' WHEN sc.id % 37 = 9 THEN 'UNK' ELSE h.currency END AS stratum, f1, exact, sc.id % 31 <> 0 AND sc.id % 9 <> 5 AS repaired, round((1 - f1) + 0.5 * CAST(sc.id % 31 <> 0 AND sc.id % 9 <> 5 AS INT) + 0.5 * CAST(NOT exact AS INT), 9) AS informativeness FROM sc JOIN h ON h.id = sc.id),
  q AS (SELECT stratum, count(*) AS size, count(*) * CAST(60 AS DOUBLE) / sum(count(*)) OVER () AS quota FROM items GROUP BY 1),
  al AS (SELECT stratum, size, CAST(floor(quota) + CASE WHEN row_number() OVER (ORDER BY quota - floor(quota) DESC, size DESC, stratum DESC) <= 60 - sum(floor(quota)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS alloc FROM q) """


def _items(spark, sf_dir):
    """Candidates, some without a reply and some without a currency on either side."""
    bare = lambda c: F.when(F.col(c).isNotNull(), F.col(c).withField("currency", F.when((F.col("id") % 37 != 9) | ((F.col("id") % 29 != 0) & (F.col("id") % 19 == 6)), F.col(c)["currency"])))
    docs = _replied(spark, sf_dir).select("id", bare("pred").alias("pred"), bare("gold").alias("gold"), F.when(F.col("id") % 31 != 0, F.col("raw")).alias("raw"))
    return keep(review.candidates(docs).withColumn("informativeness", F.round("informativeness", PLACES)), "items")


@query(_ITEMS + "SELECT id, stratum, repaired, informativeness FROM items")
def candidates(spark, sf_dir):
    return _items(spark, sf_dir).select("id", "stratum", "repaired", "informativeness")


@query(_ITEMS + "SELECT id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY id) AS r FROM items) x WHERE r <= 7")
def limited(spark, sf_dir):
    return review.limited(_items(spark, sf_dir), "stratum", 7).select("id", "stratum")


@query(_ITEMS + "SELECT stratum, size, alloc FROM al")
def allocation(spark, sf_dir):
    return review.allocate(_items(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("size")), 60)


@query(_ITEMS + "SELECT id, stratum, informativeness, rank FROM (SELECT items.*, row_number() OVER (PARTITION BY items.stratum ORDER BY informativeness DESC, id) AS rank FROM items) x JOIN al USING (stratum) WHERE rank <= alloc")
def stratified_sample(spark, sf_dir):
    return review.stratified_sample(_items(spark, sf_dir), 60)


def _raters(spark, sf_dir):
    name = lambda c: F.when(c == 1, "correct").when(c == 0, "incorrect")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), name(F.col("quality")).alias("a"), F.when(F.col("doc_id") % 9 != 0, name(1 - F.col("toxic"))).alias("b"))


_RATERS = "WITH r AS (SELECT doc_id AS id, CASE quality WHEN 1 THEN 'correct' WHEN 0 THEN 'incorrect' END AS a, CASE WHEN doc_id % 9 <> 0 THEN CASE toxic WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' END END AS b FROM labels), two AS (SELECT * FROM r WHERE a IS NOT NULL AND b IS NOT NULL) "


@query(_RATERS + """, m AS (SELECT l, sum(x) AS x, sum(y) AS y FROM (SELECT a AS l, 1 AS x, 0 AS y FROM two UNION ALL SELECT b, 0, 1 FROM two) GROUP BY 1),
  s AS (SELECT (SELECT count(*) FROM two) AS n, (SELECT avg(CAST(a = b AS INT)) FROM two) AS po, (SELECT CAST(sum(x * y) AS DOUBLE) FROM m) AS xy)
  SELECT n, round(po, 9) AS po, round(xy / (CAST(n AS DOUBLE) * n), 9) AS pe, round((po - xy / (CAST(n AS DOUBLE) * n)) / (1 - xy / (CAST(n AS DOUBLE) * n)), 9) AS kappa FROM s""".replace(", m AS", ", m AS", 1))
def rater_kappa(spark, sf_dir):
    return review.rater_scores(_raters(spark, sf_dir)).select("n", *_r("po", "pe", "kappa"))


@query(_RATERS + ", l AS (SELECT a AS l FROM two UNION SELECT b FROM two) SELECT x.l AS a, y.l AS b, (SELECT count(*) FROM two WHERE two.a = x.l AND two.b = y.l) AS n FROM l x CROSS JOIN l y")
def rater_confusion(spark, sf_dir):
    return review.confusion(_raters(spark, sf_dir))


@query(_RATERS + "SELECT id, a, b FROM two WHERE a <> b")
def rater_disagreements(spark, sf_dir):
    return _raters(spark, sf_dir).where("a is not null and b is not null and a <> b")


@query("""WITH k AS (SELECT o_orderkey AS id, md5(CAST(o_orderkey AS VARCHAR) || ':17') AS h FROM orders), o AS (SELECT id, row_number() OVER (ORDER BY h, id) - 1 AS ordinal, count(*) OVER () AS n FROM k)
  SELECT id, ordinal, CASE WHEN ordinal < floor(n * 0.72) THEN 'train' WHEN ordinal < floor(n * 0.72) + floor(n * 0.1) THEN 'dev' WHEN ordinal < floor(n * 0.72) + floor(n * 0.1) + 60 THEN 'gold' WHEN ordinal < floor(n * 0.72) + floor(n * 0.1) + 90 THEN 'agreement' ELSE 'test' END AS split FROM o""")
def random_split(spark, sf_dir):
    return review.split(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


@query(_RATERS + """, x AS (SELECT id, a, b FROM r WHERE id % 7 <> 0 AND a IS NOT NULL AND b IS NOT NULL), m AS (SELECT l, sum(x) AS x, sum(y) AS y FROM (SELECT a AS l, 1 AS x, 0 AS y FROM x UNION ALL SELECT b, 0, 1 FROM x) GROUP BY 1),
  s AS (SELECT count(*) AS n, avg(CAST(a = b AS INT)) AS po, count(*) FILTER (a <> b) AS n_disagreements, count(*) FILTER (a = 'correct' AND b = 'correct') AS cc, count(*) FILTER (a = 'correct' AND b = 'incorrect') AS ci, count(*) FILTER (a = 'incorrect' AND b = 'correct') AS ic, count(*) FILTER (a = 'incorrect' AND b = 'incorrect') AS ii FROM x),
  k AS (SELECT s.*, (po - pe) / (1 - pe) AS kappa FROM s, (SELECT CAST(sum(m.x * m.y) AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) * count(*) FROM x) AS pe FROM m) p)
  SELECT n, round(po, 9) AS po, round(kappa, 9) AS kappa, n_disagreements, cc, ci, ic, ii, CASE WHEN kappa >= 0.7 THEN 'PASS' ELSE 'REVISE' END AS verdict FROM k""")
def score_raters(spark, sf_dir):
    """Sheets in which ids occur again: an earlier opposite label, and a later row without one."""
    rows = _raters(spark, sf_dir)
    other = F.when(F.col("label") == "correct", "incorrect").otherwise("correct")
    sheet = lambda c: rows.select("id", F.col(c).alias("label")).select("id", F.inline(F.array(F.struct(F.when(F.col("id") % 4 == 0, other).alias("label"), F.lit(1).alias("ord")), F.struct(F.col("label"), F.lit(2).alias("ord")), F.struct(F.lit(None).cast("string").alias("label"), F.lit(3).alias("ord")))))
    out = review.score_raters(sheet("a").where("id % 7 <> 0"), sheet("b").where("id % 9 <> 0"))
    cells = [F.col("confusion")[f"{x}|{y}"].alias(x[0] + y[0]) for x in ("correct", "incorrect") for y in ("correct", "incorrect")]
    return out.select("n", *_r("po", "kappa"), "n_disagreements", *cells, "verdict")


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS n_correct, count(*) FILTER (quality = 0) AS n_incorrect, round(avg(quality), 9) AS human_verified_accuracy, round(avg(quality), 9) AS precision_correct, CAST(1 AS DOUBLE) AS recall_correct FROM labels")
def human_accuracy(spark, sf_dir):
    out = review.human_accuracy(_raters(spark, sf_dir).select(F.col("a").alias("label")))
    return out.select("n", "n_correct", "n_incorrect", *_r("human_verified_accuracy", "precision_correct"), "recall_correct")


def _texts(spark, sf_dir, name="documents", key="doc_id"):
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), "text")


_WS = "[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+"
#: grams (id, g, n): the distinct trigrams of documents; classes (id, rep); pairs (a, b, similarity) of all documents.
_PAIRS = f"""WITH RECURSIVE norm AS (SELECT doc_id AS id, lower(trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'))) AS s FROM documents),
  chars AS (SELECT id, length(s) AS m, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i FROM norm WHERE s <> ''),
  three AS (SELECT id, m, c, lead(c, 1) OVER w AS d, lead(c, 2) OVER w AS e FROM chars WINDOW w AS (PARTITION BY id ORDER BY i)),
  said AS (SELECT DISTINCT id, coalesce(c || d || e, CASE WHEN m < 3 THEN c || coalesce(d, '') END) AS g FROM three WHERE e IS NOT NULL OR (m < 3 AND (d IS NOT NULL OR m = 1))),
  coded AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY g) AS g, count(*) OVER (PARTITION BY id) AS n FROM said),
  classes AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY k) AS rep FROM (SELECT norm.id, coalesce(string_agg(g, ',' ORDER BY g), '') AS k FROM norm LEFT JOIN coded ON coded.id = norm.id GROUP BY 1) x),
  shared AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m FROM coded a JOIN coded b ON a.g = b.g AND a.id < b.id AND a.n >= 0.9 * b.n AND b.n >= 0.9 * a.n GROUP BY 1, 2),
  pairs AS MATERIALIZED (SELECT a, b, CAST(m AS DOUBLE) / (na + nb - m) AS similarity FROM shared WHERE CAST(m AS DOUBLE) / (na + nb - m) >= 0.9)"""
#: settled (id, kept): in the order of id; a row is dropped where an earlier kept one is similar. p has the pairs.
_GREEDY = """, inside AS (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM (SELECT a AS id FROM p UNION SELECT b FROM p) x),
  step(pos, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT i.pos, CASE WHEN list_has_any(s.kept, coalesce((SELECT list(p.a) FROM p WHERE p.b = i.id), CAST([] AS BIGINT[]))) THEN s.kept ELSE list_append(s.kept, i.id) END FROM step s JOIN inside i ON i.pos = s.pos + 1),
  settled AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM step ORDER BY pos DESC LIMIT 1) x),
  best AS (SELECT b AS id, first(a ORDER BY similarity DESC, a) AS dup_of, max(similarity) AS similarity FROM p WHERE a IN (SELECT id FROM settled) AND b NOT IN (SELECT id FROM settled) GROUP BY 1) """


@query(_PAIRS + """ SELECT a, b, round(similarity, 9) AS similarity FROM pairs WHERE a IN (SELECT rep FROM classes) AND b IN (SELECT rep FROM classes)
  UNION ALL SELECT rep, id, CAST(1 AS DOUBLE) FROM classes WHERE id <> rep AND id IN (SELECT id FROM coded)""")
def jaccard_pairs(spark, sf_dir):
    """Pairs of documents with trigram Jaccard of at least 0.9, copies next to the first of them."""
    return similarity.class_pairs(similarity.classed(_texts(spark, sf_dir))).withColumn("similarity", F.round("similarity", PLACES))


@query(_PAIRS + ", p AS (SELECT * FROM pairs)" + _GREEDY + "SELECT norm.id, best.id IS NULL AS kept, dup_of, round(similarity, 4) AS similarity FROM norm LEFT JOIN best ON best.id = norm.id")
def greedy_dedup(spark, sf_dir):
    """Greedy dedup of documents by trigram Jaccard, in the order of doc_id."""
    return similarity.dedup_texts(_texts(spark, sf_dir))


@query(_PAIRS + """, held AS (SELECT id FROM norm WHERE id % 5 = 0), void AS (SELECT id FROM norm WHERE id NOT IN (SELECT id FROM coded)),
  met AS (SELECT a, b, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs UNION ALL SELECT x.id, y.id, CAST(1 AS DOUBLE) FROM void x, void y WHERE x.id <> y.id),
  first AS (SELECT rep, min(id) AS b FROM classes WHERE id % 5 <> 0 GROUP BY 1)
  SELECT met.a AS doc_id, first.b AS item_id, round(max(similarity), 9) AS similarity FROM met JOIN held ON held.id = met.a JOIN classes c ON c.id = met.b JOIN first ON first.rep = c.rep WHERE met.b % 5 <> 0 GROUP BY 1, 2""")
def leak_check(spark, sf_dir):
    """Held-out documents (a fifth) that are near copies of others; of equal ones the first is named."""
    docs = _texts(spark, sf_dir)
    found = similarity.leaks(similarity.classed(docs.where("id % 5 = 0")), similarity.classed(docs.where("id % 5 <> 0")))
    return found.select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), F.round("similarity", PLACES).alias("similarity"))


@query(f"""WITH norm AS (SELECT item_id AS id, lower(trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'))) AS s FROM benchmark)
  SELECT id, list_sort(list_distinct(CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 3 THEN [s] ELSE list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) END))::VARCHAR AS grams FROM norm""")
def gram_sets(spark, sf_dir):
    rows = _texts(spark, sf_dir, "benchmark", "item_id").select("id", F.array_sort(similarity.grams(F.col("text"))).alias("g"))
    quoted = F.transform("g", lambda x: F.when(x.rlike(r"""^\s|\s$|[\[\]{}(),'"\\]|^$|(?i)^null$"""), F.concat(F.lit("'"), F.regexp_replace(x, r"(['\\])", r"\\$1"), F.lit("'"))).otherwise(x))
    return rows.select("id", F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("grams"))


_WORDS = "CASE WHEN doc_id % 11 = 0 THEN '' ELSE lower(array_to_string(list_slice(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), 1, 12), ' ')) END"


@query(f"""WITH w AS (SELECT doc_id AS id, trim({_WORDS}) AS s FROM documents), g AS (SELECT id, list_distinct(CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 3 THEN [s] ELSE list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) END) AS g FROM w)
  SELECT a.id, round(CASE WHEN len(a.g) = 0 AND len(b.g) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) END, 9) AS similarity FROM g a JOIN g b ON b.id = a.id + 11""")
def jaccard_scores(spark, sf_dir):
    """The first words of a document and of the one 11 ids on; where both have none they are the same."""
    first = F.array_join(F.slice(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " "), 1, 12), " ")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), similarity.grams(F.when(F.col("doc_id") % 11 == 0, "").otherwise(first)).alias("g"))
    met = rows.join(rows.select((F.col("id") - 11).alias("id"), F.col("g").alias("h")), "id")
    return met.select("id", F.round(similarity.jaccard(F.col("g"), F.col("h")), PLACES).alias("similarity"))


def _vectors(spark, sf_dir):
    """The vectors, a near copy of every third, and one near that copy of every sixth."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    moved = lambda step, by: v.where(F.col("id") % step == 0).select((F.col("id") + F.lit(by * 1_000_000)).alias("id"), F.transform("v", lambda x, i: x + F.when(i % 2 == 0, 0.03 * by).otherwise(0.0)).alias("v"))
    return v.unionAll(moved(3, 1)).unionAll(moved(6, 2))


_VECTORS = """WITH RECURSIVE v0 AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  v AS MATERIALIZED (SELECT id, e FROM v0 UNION ALL SELECT id + 1000000, list_transform(e, lambda x, i: x + CASE WHEN i % 2 = 1 THEN 0.03::DOUBLE ELSE 0::DOUBLE END) FROM v0 WHERE id % 3 = 0
    UNION ALL SELECT id + 2000000, list_transform(e, lambda x, i: x + CASE WHEN i % 2 = 1 THEN 0.06::DOUBLE ELSE 0::DOUBLE END) FROM v0 WHERE id % 6 = 0),
  p AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS similarity FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.9)"""


@query(_VECTORS + " SELECT a, b, round(similarity, 6) AS similarity FROM p")
def cosine_pairs(spark, sf_dir):
    return similarity.cosine_pairs(_vectors(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query(_VECTORS + _GREEDY + "SELECT v.id, best.id IS NULL AS kept, dup_of FROM v LEFT JOIN best ON best.id = v.id")
def embedding_dedup(spark, sf_dir):
    """Greedy dedup by cosine, by the method that is taken where vectors are given."""
    v = _vectors(spark, sf_dir)
    return similarity.dedup_texts(v.select("id"), "auto", vectors=v).select("id", "kept", "dup_of")


#: Documents with white space of several kinds around them.
_PADDED = "WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN chr(9) || text || chr(10) WHEN 2 THEN chr(160) || text || chr(8195) WHEN 3 THEN ' ' || text || chr(28) ELSE text END AS text FROM documents), k AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^" + _WS + "', ''), '" + _WS + "$', '') AS t FROM d) "


def _padded(spark, sf_dir):
    around = {1: ("\t", "\n"), 2: ("\xa0", "\u2003"), 3: (" ", "\x1c")}
    text = F.coalesce(*[F.when(F.col("doc_id") % 4 == i, F.concat(F.lit(a), F.col("text"), F.lit(b))) for i, (a, b) in around.items()], F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(_PADDED + "SELECT doc_id, 'seed-' || substr(sha256(t), 1, 16) AS content_id, length(t) >= 40 AS long_enough FROM k")
def content_ids(spark, sf_dir):
    return _padded(spark, sf_dir).select("doc_id", normalise.content_id(F.col("text")).alias("content_id"), normalise.long_enough(F.col("text")).alias("long_enough"))


@query(_PADDED + "SELECT min(doc_id) AS doc_id, 'seed-' || substr(sha256(t), 1, 16) AS content_id, count(*) AS copies FROM k GROUP BY 2")
def content_dedup(spark, sf_dir):
    return _padded(spark, sf_dir).groupBy(normalise.content_id(F.col("text")).alias("content_id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def _batches(spark, sf_dir):
    """Replies with a batch of one text (and what isn't one): bare, in a fence, an object, and none."""
    j = F.to_json(F.array("text"))
    mixed = F.concat(F.substring(j, F.lit(1), F.length(j) - 1), F.lit(',5,null,["x"],"  too short  "]'))
    forms = (mixed, F.concat(F.lit("Here:\n```json\n"), mixed, F.lit("\n```")), F.concat(F.lit('{"a":'), j, F.lit("}")), F.lit("I won't."))
    k = F.col("doc_id") % 4
    return _padded(spark, sf_dir).select(F.col("doc_id").alias("batch"), F.coalesce(*[F.when(k == i, f) for i, f in enumerate(forms)]).alias("reply"))


@query(_PADDED + "SELECT doc_id AS batch, CASE WHEN doc_id % 4 < 2 THEN CASE WHEN length(t) >= 40 THEN 1 ELSE 0 END END AS n, CASE WHEN doc_id % 4 < 2 AND length(t) >= 40 THEN md5(t) END AS first FROM k")
def generated_batches(spark, sf_dir):
    texts = gate.batch_texts(F.col("reply"))
    return _batches(spark, sf_dir).select("batch", F.when(texts.isNotNull(), F.size(texts)).alias("n"), F.md5(F.get(texts, F.lit(0))).alias("first"))


@query(_PADDED + """, i AS (SELECT doc_id, 'seed-' || substr(sha256(t), 1, 16) AS id, length(t) >= 40 AS ok FROM k) SELECT id, min(doc_id) AS batch FROM i WHERE ok AND doc_id % 4 < 2 AND id NOT IN (SELECT id FROM i WHERE doc_id % 10 = 4) GROUP BY 1""")
def new_seeds(spark, sf_dir):
    seen = _padded(spark, sf_dir).where("doc_id % 10 = 4").select(normalise.content_id(F.col("text")).alias("id"))
    return calls.new_seeds(_batches(spark, sf_dir), seen).select("id", "batch")


@query(_PADDED + """, i AS (SELECT doc_id, 'seed-' || substr(sha256(t), 1, 16) AS id, length(t) >= 40 AS ok FROM k) SELECT id FROM (SELECT id, min(doc_id) AS first_id FROM i WHERE ok GROUP BY 1) x ORDER BY first_id LIMIT 25""")
def generate_until(spark, sf_dir):
    """A caller that hands out documents in order, some replies without any."""
    texts = iter([r.text for r in _padded(spark, sf_dir).orderBy("doc_id").limit(120).collect()])

    def ask(batch: int, want: int) -> str:
        return "Sorry." if batch % 3 == 1 else json.dumps([next(texts) for _ in range(want)])

    return calls.until(spark, 25, ask).select("id")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice, 2) AS us, round(l_extendedprice, 2) AS eu, round(-l_extendedprice, 2) AS closed, round(l_extendedprice, 2) AS plain,
  round(l_extendedprice, 2) AS noted, round(l_extendedprice, 2) AS twice, floor(l_extendedprice) * 1000 + 567 AS whole, CAST(NULL AS DOUBLE) AS none FROM lineitem""")
def money_formats(spark, sf_dir):
    """Amounts printed in several styles and parsed back: thousands by comma or dot, negative in parentheses with white
    space around, a note in parentheses (not negative), two minus signs (positive), whole thousands, and no number."""
    x = F.col("l_extendedprice")
    us = F.format_number(x, 2)
    eu = F.translate(us, ",.", ".,")
    back = {"us": F.concat(F.lit("\t$"), us), "eu": F.concat(eu, F.lit("\xa0€\n")), "closed": F.concat(F.lit("\t("), us, F.lit(")\n")), "plain": F.format_string("%.2f", x)}
    back |= {"noted": F.concat(F.lit("USD ("), us, F.lit(") net")), "twice": F.concat(F.lit("--"), us), "whole": F.concat(F.floor(x).cast("string"), F.lit(".567")), "none": F.concat(F.lit("("), F.translate(us, "0123456789", ""), F.lit(")"))}
    back["whole"] = F.concat(F.format_number(F.floor(x), 0), F.lit(",567"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x, *[normalise.money(v).alias(k) for k, v in back.items()])


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 2) AS pcs, round(l_quantity + 0.5, 2) AS hours, CAST(NULL AS DOUBLE) AS word FROM lineitem")
def quantity_formats(spark, sf_dir):
    q = F.col("l_quantity")
    forms = {"pcs": F.concat(F.format_string("%.0f", q), F.lit(" PCS.\n")), "hours": F.concat(F.lit("\t"), F.translate(F.format_string("%.1f", q + 0.5), ".", ","), F.lit(" hrs")), "word": F.lit("some units")}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[normalise.quantity(v).alias(k) for k, v in forms.items()])


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) + 0.5 AS size, CAST(NULL AS DOUBLE) AS none FROM part")
def model_sizes(spark, sf_dir):
    name = F.concat(F.lit("org/model-2b-v"), F.col("p_partkey"), F.lit("-"), F.col("p_size"), F.lit(".5B-instruct"))
    return table(spark, sf_dir, "part").select("p_partkey", normalise.model_size(name).alias("size"), normalise.model_size(F.lit("7bit")).alias("none"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS compact, strftime(o_orderdate, '%Y-%m-%d') AS textual,
  CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%d-%m') END AS day_first FROM orders""")
def date_formats(spark, sf_dir):
    """Dates printed in four styles and parsed back; day first is read as month first where both could be."""
    d = F.col("o_orderdate")
    forms = {"iso": "yyyy/MM/dd", "compact": "yyyyMMdd", "textual": "MMMM d, yyyy", "day_first": "dd.MM.yyyy"}
    around = lambda x: F.concat(F.lit("\t"), x, F.lit("\xa0\n"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[normalise.date_iso(around(F.date_format(d, f))).alias(k) for k, f in forms.items()])


@query("SELECT c_custkey, list_extract(['USD','EUR','GBP','PKR','INR'], CAST(c_nationkey % 5 + 1 AS INT)) AS currency FROM customer")
def currency_codes(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ("\tUS$\n", "euros", "\xa0£", "Rs.", "\x1f indian rupees "))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", normalise.currency(said).alias("currency"))


def _calls(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("-2024-06-01")).alias("model"), k.alias("tokens_in"), (F.col("user_id") % 97).alias("tokens_out"), (F.col("event_id") % 4 == 0).alias("cached"), F.col("value").alias("latency"))


_CALLS = "WITH c AS (SELECT event_id, event_type || '-2024-06-01' AS model, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_in, user_id % 97 AS tokens_out, event_id % 4 = 0 AS cached, value AS latency FROM events) "


@query(_CALLS + """, t AS (SELECT *, CASE WHEN event_type < 'd' THEN 3.0 ELSE 1.0 END AS pin, CASE WHEN event_type < 'd' THEN 15.0 ELSE 5.0 END AS pout FROM c)
  SELECT model, sum(CASE WHEN cached THEN 0 ELSE 1 END)::BIGINT AS calls, sum(CASE WHEN cached THEN 1 ELSE 0 END)::BIGINT AS hits, sum(CASE WHEN cached THEN 0 ELSE tokens_in END)::BIGINT AS tokens_in, sum(CASE WHEN cached THEN 0 ELSE tokens_out END)::BIGINT AS tokens_out,
  round(sum(CASE WHEN cached THEN 0 ELSE tokens_in / 1e6 * pin + tokens_out / 1e6 * pout END), 6) AS usd,
  round(CAST(sum(CASE WHEN cached THEN 0 ELSE tokens_in + tokens_out END) AS DOUBLE) / greatest(sum(CASE WHEN cached THEN 0 ELSE 1 END), 1), 6) AS tokens_per_call FROM t GROUP BY model""")
def usage_report(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    early = F.col("event_type") < "d"
    rows = kinds.select(F.col("event_type").alias("prefix"), F.lit(1).alias("ord"), F.when(early, 3.0).otherwise(1.0).alias("price_in"), F.when(early, 15.0).otherwise(5.0).alias("price_out"))
    return cost.usage(cost.prices(calls, rows)).withColumn("usd", F.round("usd", 6)).withColumn("tokens_per_call", F.round("tokens_per_call", 6))


@query(_CALLS + "SELECT model, round(quantile_cont(latency, 0.5), 9) AS p50, round(quantile_cont(latency, 0.95), 9) AS p95, round(1 / greatest(avg(latency), 1e-9), 6) AS per_second FROM c GROUP BY 1")
def latency_report(spark, sf_dir):
    told = reports.latencies(_calls(spark, sf_dir), by=("model",))
    return told.select("model", F.round("p50", PLACES).alias("p50"), F.round("p95", PLACES).alias("p95"), F.round("per_second", 6).alias("per_second"))


@query("""WITH d AS (SELECT greatest(max(n), 10) AS top FROM (SELECT count(*) AS n FROM events GROUP BY CAST(ts AS DATE))), v AS (SELECT unnest(generate_series(0, top + greatest(top // 60, 1) - 1, greatest(top // 60, 1))) AS volume FROM d)
  SELECT volume, round(volume * (900 / 1e6 * 3 + 350 / 1e6 * 15), 9) AS api_usd, round(24 * (1100.0 / (3 * 365 * 24) * 1.0) + volume * (0.36 * 0.15 / (4 * 3600.0)), 9) AS own_usd FROM v""")
def cost_curves(spark, sf_dir):
    """Daily cost by volume, up to the busiest day's: API against amortised hardware plus energy."""
    top = table(spark, sf_dir, "events").groupBy(F.to_date("ts")).count().agg(F.max("count")).first()[0]  # one number
    api = cost.api_cost(F.lit(900), F.lit(350), F.lit(3.0), F.lit(15.0))
    out = cost.daily_curves(spark, cost.volume_axis(top or 0), api, 1100, 3, 1.0, reports.Machine().energy(F.lit(4.0)))
    return out.select("volume", *_r("api_usd", "own_usd"))


_REPORT = COMPARED + """, q AS (SELECT count(*) AS n, avg(f1) AS f1_macro, avg(CAST(exact AS INT)) AS exact_rate, avg(agreement) AS agreement FROM sc),
  e AS (SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, 1 / avg(value) AS per_second FROM events),
  rep AS (SELECT *, f1_macro AS ratio, f1_macro >= 0.95 AS meets_bar, CAST(7.95 AS DOUBLE) AS api_1k, (1100.0 / 26280 + 0.054) / (per_second * 3600) * 1000 AS own_1k FROM q CROSS JOIN e),
  rep2 AS (SELECT *, api_1k / own_1k AS multiple, CASE WHEN 0.00795 > 0.054 / (per_second * 3600) THEN 1100.0 / 1095 / (0.00795 - 0.054 / (per_second * 3600)) END AS break_even FROM rep) """


def _report(spark, sf_dir):
    scores = extraction.batch_scores(_scores(spark, sf_dir))
    api = cost.api_cost(F.lit(900), F.lit(350), F.lit(3.0), F.lit(15.0))
    return reports.evaluation(scores, reports.latencies(_calls(spark, sf_dir)), api, reports.Machine())


@query(_REPORT + "SELECT n, round(f1_macro, 9) AS f1_macro, round(ratio, 9) AS ratio, meets_bar, round(p50, 9) AS p50, round(p95, 9) AS p95, round(per_second, 9) AS per_second, round(api_1k, 6) AS api_1k, round(own_1k, 6) AS own_1k, round(multiple, 6) AS multiple, round(break_even, 6) AS break_even FROM rep2")
def evaluation_report(spark, sf_dir):
    costs = [F.round(c, 6).alias(c) for c in ("api_1k", "own_1k", "multiple", "break_even")]
    return _report(spark, sf_dir).select("n", *_r("f1_macro", "ratio"), "meets_bar", *_r("p50", "p95", "per_second"), *costs)


@query(_REPORT + """, t AS (SELECT unnest([
  {'ord': 0, 'metric': '$/1k requests', 'teacher': printf('$%.2f', api_1k), 'student': printf('$%.4f', own_1k), 'win': format('{:,}x cheaper', CAST(round(multiple) AS BIGINT))},
  {'ord': 1, 'metric': 'Quality (f1_macro)', 'teacher': '1.0000 (ref)', 'student': printf('%.4f', f1_macro), 'win': printf('%.1f%%', ratio * 100) || ' of teacher — ' || CASE WHEN meets_bar THEN 'meets' ELSE 'below' END || ' 95% bar'},
  {'ord': 2, 'metric': 'Teacher-agreement (fresh pool)', 'teacher': '—', 'student': printf('%.1f%%', agreement * 100), 'win': 'generalization'},
  {'ord': 3, 'metric': 'Schema-valid rate', 'teacher': '—', 'student': 'n/a', 'win': 'robustness'},
  {'ord': 4, 'metric': 'Exact match', 'teacher': '—', 'student': printf('%.1f%%', exact_rate * 100), 'win': 'strictest view'},
  {'ord': 5, 'metric': 'p95 latency', 'teacher': '~2.1 s (typ. API)', 'student': format('{:,} ms', CAST(round(p95 * 1000) AS BIGINT)), 'win': 'lower'},
  {'ord': 6, 'metric': 'Data egress', 'teacher': 'leaves org', 'student': 'stays local', 'win': 'privacy'},
  {'ord': 7, 'metric': 'Break-even volume', 'teacher': '—', 'student': coalesce(format('~{:,} req/day', CAST(round(break_even) AS BIGINT)), 'none'), 'win': 'above this, local wins'}]) AS r FROM rep2)
  SELECT CAST(r.ord AS BIGINT) AS ord, r.metric AS metric, r.teacher AS teacher, r.student AS student, r.win AS win FROM t""")
def money_table(spark, sf_dir):
    return reports.money_table(_report(spark, sf_dir))


@query(_REPORT + """, t AS (SELECT unnest([
  {'ord': 0, 'axis': 'Model footprint', 'teacher': '14B-class', 'student': 'm-0.5B-chat (~0.5B)', 'win': '~28× smaller'},
  {'ord': 1, 'axis': 'Quality (f1_macro)', 'teacher': '1.0000 (ref)', 'student': printf('%.4f', f1_macro) || ' (' || printf('%.1f%%', ratio * 100) || ' of teacher)', 'win': CASE WHEN meets_bar THEN 'meets' ELSE 'below' END || ' 95% bar'},
  {'ord': 2, 'axis': 'Schema-valid rate', 'teacher': '—', 'student': 'n/a (after ≤2 constrained-repair retries)', 'win': 'robustness'},
  {'ord': 3, 'axis': 'Exact match', 'teacher': '—', 'student': printf('%.1f%%', exact_rate * 100), 'win': 'strictest view'},
  {'ord': 4, 'axis': 'p95 latency', 'teacher': 'full 14B forward', 'student': format('{:,} ms', CAST(round(p95 * 1000) AS BIGINT)), 'win': 'smaller footprint'},
  {'ord': 5, 'axis': 'Data egress', 'teacher': 'stays local', 'student': 'stays local', 'win': 'on-prem / private'},
  {'ord': 6, 'axis': '$/1k (GPU amortized)', 'teacher': printf('$%.4f', api_1k), 'student': printf('$%.4f', own_1k), 'win': 'both ~free locally'}]) AS r FROM rep2)
  SELECT CAST(r.ord AS BIGINT) AS ord, r.axis AS axis, r.teacher AS teacher, r.student AS student, r.win AS win FROM t""")
def local_money_table(spark, sf_dir):
    return reports.local_table(_report(spark, sf_dir), "teacher:14b", "org/m-0.5B-chat", 2)


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS label FROM labels")
def label_aliases(spark, sf_dir):
    said = F.when(F.col("quality") == 1, F.element_at(F.array(*map(F.lit, ("Correct", "\tok\n", "YES\xa0", "1"))), (F.col("doc_id") % 4 + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, ("wrong", "No", " BAD", "0"))), (F.col("doc_id") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "labels").select("doc_id", normalise.label(said).alias("label"))


def _replies(spark, sf_dir, docs=None):
    """id, reply, and what docs (id, gold) has: an invoice as a model may send it, by id % 9: fenced, in prose, none, with a key too many, without its
    date, with an amount as text, without lines, in an array, with a truth value as tax."""
    k = F.col("id") % 9
    g = F.when(k == 6, F.col("gold").withField("line_items", F.slice("gold.line_items", 1, 0))).otherwise(F.col("gold"))
    j = F.col("j")
    forms = (
        F.concat(F.lit("Here it is:\n```json\n"), j, F.lit("\n```\nDone.")),
        F.concat(F.lit("Sure {as asked}: "), j, F.lit(" I hope [1] that helps")),
        F.lit("I can't read this."),
        F.regexp_replace(j, r"^\{", '{"note":"x",'),
        F.regexp_replace(j, '"date":"[^"]*",', ""),
        F.regexp_replace(j, '"grand_total":[^,}]*', r'"grand_total":"\$1,234.50"'),
        j,
        F.concat(F.lit("["), j, F.lit("]")),
        F.regexp_replace(j, '"tax":[^,}]*', '"tax":true'),
    )
    rows = gold(spark, sf_dir) if docs is None else docs
    return rows.select(*rows.columns, F.to_json(g).alias("j")).select(*rows.columns, F.coalesce(*[F.when(k == i, f) for i, f in enumerate(forms)]).alias("reply"))


def _replied(spark, sf_dir):
    """id, gold, pred, raw: the damaged invoices, and replies as above."""
    return _replies(spark, sf_dir, _invoices(spark, sf_dir)).withColumnRenamed("reply", "raw")


_REASON = "CASE h.id % 9 WHEN 2 THEN 'schema: not_json' WHEN 3 THEN 'schema: extra:note' WHEN 4 THEN 'schema: missing:date' WHEN 6 THEN 'schema: empty:line_items' WHEN 7 THEN 'schema: not_object' WHEN 8 THEN 'schema: type:tax' END"


@query(SQL + f", g AS (SELECT h.*, {_REASON} AS drop_reason FROM h) SELECT id, drop_reason, CASE WHEN drop_reason IS NULL THEN vendor END AS vendor, CASE WHEN drop_reason IS NULL THEN date END AS date, CASE WHEN drop_reason IS NULL THEN currency END AS currency, CASE WHEN drop_reason IS NULL THEN round(subtotal, 2) END AS subtotal, CASE WHEN drop_reason IS NULL THEN CASE WHEN id % 9 = 5 THEN CAST(1234.5 AS DOUBLE) ELSE round(grand_total, 2) END END AS grand_total, CASE WHEN drop_reason IS NULL THEN m END AS lines, CASE WHEN drop_reason IS NULL THEN terms END AS terms FROM g")
def schema_gate(spark, sf_dir):
    """Replies through JSON extraction and the gate, both sides in one table."""
    out = gate.schema_gate(_replies(spark, sf_dir).withColumn("output", gate.first_json(F.col("reply"))))
    i = F.col("invoice")
    return out.select("id", F.col("_drop_reason").alias("drop_reason"), i["vendor"].alias("vendor"), i["date"].alias("date"), i["currency"].alias("currency"), i["subtotal"].alias("subtotal"), i["grand_total"].alias("grand_total"), F.when(i.isNotNull(), F.size(i["line_items"])).cast("long").alias("lines"), i["payment_terms"].alias("terms"))


@query(SQL + f" SELECT coalesce({_REASON}, 'kept') AS gate, count(*) AS n FROM h GROUP BY 1")
def drop_report(spark, sf_dir):
    return schema_gate(spark, sf_dir).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("gate")).agg(F.count("*").alias("n"))


@query(SQL + " SELECT round(avg(CASE WHEN id % 9 = 5 THEN 1 ELSE 0 END), 9) AS rate FROM h")
def schema_valid_rate(spark, sf_dir):
    """Share of replies that meet the contract as they stand."""
    ok = F.size(gate.validate(F.col("reply"))["errors"]) == 0
    return _replies(spark, sf_dir).agg(F.round(F.coalesce(F.avg(ok.cast("int")), F.lit(0.0)), PLACES).alias("rate"))


@query(SQL + " SELECT id, id % 2 = 0 OR id % 3 = 0 AS valid, CAST(CASE WHEN id % 2 = 0 THEN 2 ELSE 3 END AS BIGINT) AS attempts, CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN vendor END AS vendor, CASE WHEN NOT (id % 2 = 0 OR id % 3 = 0) THEN 'no JSON found' END AS error FROM h")
def retry_resolution(spark, sf_dir):
    """Logs of three attempts, of which the second or the third may pass."""
    g = gold(spark, sf_dir).withColumn("good", F.to_json("gold")).withColumn("bad", F.lit("none"))
    tries = F.array(*[F.struct(F.lit(n).alias("attempt"), F.when(ok, F.col("good")).otherwise(F.col("bad")).alias("reply")) for n, ok in ((1, F.lit(False)), (2, F.col("id") % 2 == 0), (3, F.col("id") % 3 == 0))])
    return calls.resolve(g.select("id", F.inline(tries))).select("id", "valid", "attempts", F.col("invoice.vendor").alias("vendor"), "error")


@query("""WITH k AS (SELECT event_id, substr(sha256('{"max_tokens":null,"model":"' || event_type || '","provider":null,"salt":"' || event_id % 3 || '","system":null,"temperature":"0.0","user":"' || json_extract_string(props, '$.k') || '"}'), 1, 40) AS key FROM events)
  SELECT event_id, key, key IN (SELECT key FROM k WHERE event_id % 4 = 0) AS cached FROM k""")
def cache_lookup(spark, sf_dir):
    key = prompts.call_key(model=F.col("event_type"), user=F.get_json_object("props", "$.k"), temperature=F.lit("0.0"), salt=F.col("event_id") % 3)
    asked = table(spark, sf_dir, "events").select("event_id", key.alias("key"))
    return calls.with_cache(asked, asked.where("event_id % 4 = 0").select("key", F.lit("reply").alias("reply"))).select("event_id", "key", "cached")


@query("""SELECT doc_id, 'S' AS system, '<document>' || chr(10) || text || chr(10) || '</document>' || chr(10) || 'Output:' AS "user", '{}' AS assistant, CASE doc_id % 3 WHEN 1 THEN 'retail' WHEN 2 THEN 'hotels' END AS hint FROM documents""")
def chat_messages(spark, sf_dir):
    m = prompts.training_messages("S", F.col("text"), F.lit("{}"))
    return table(spark, sf_dir, "documents").select("doc_id", *[m[i]["content"].alias(c) for i, c in enumerate(("system", "user", "assistant"))], prompts.hint(F.col("doc_id"), [None, "retail", "hotels"]).alias("hint"))


@query("SELECT doc_id, list_extract(['incorrect','correct','incorrect','correct','incorrect','incorrect'], CAST(doc_id % 6 + 1 AS INT)) AS label FROM labels")
def free_text_labels(spark, sf_dir):
    said = F.array(*map(F.lit, ("This is incorrect.", "- label: OK\nas printed", "hm\n\n* wrong, I think", "It looks correct", "no idea", "** Bad")))
    return table(spark, sf_dir, "labels").select("doc_id", prompts.label_in(F.element_at(said, (F.col("doc_id") % 6 + 1).cast("int"))).alias("label"))


_AMOUNTS = "leaf IN ('total', 'subtotal', 'tax', 'grand_total')"


@query(SQL + f""", doc AS (SELECT id, string_agg(printf('%.2f', floor(n * 100 + 0.5) / 100), chr(10)) AS doc FROM gold_f WHERE {_AMOUNTS} GROUP BY 1),
  tok AS (SELECT id, printf('%.2f', floor(n * 100 + 0.5) / 100) AS t FROM pred_f WHERE {_AMOUNTS}),
  sh AS (SELECT id, avg(CASE WHEN contains(doc, t) OR contains(doc, rtrim(rtrim(t, '0'), '.')) THEN 1 ELSE 0 END) AS share FROM tok JOIN doc USING (id) GROUP BY 1),
  l AS (SELECT ids.id, CASE WHEN share >= 1 THEN 'correct' ELSE 'incorrect' END AS a, CASE WHEN share >= CAST(0.6 AS DOUBLE) THEN 'correct' ELSE 'incorrect' END AS b FROM ids LEFT JOIN sh USING (id)) SELECT id, a, b, b AS settled FROM l""")
def rule_raters(spark, sf_dir):
    """Damaged invoices held against the amounts that the document prints."""
    both = predicted(gold(spark, sf_dir))
    every = lambda x: F.concat(F.array(x["subtotal"], x["tax"], x["grand_total"]), F.transform(x["line_items"], lambda y: y["total"]))
    document = F.array_join(F.transform(every(F.col("gold")), lambda x: F.format_string("%.2f", cents(x).cast("double"))), "\n")
    p = F.col("pred")
    whole = p.withField("grand_total", cents(p["grand_total"]).cast("double"))
    return review.rule_labels(both.select("id", document.alias("document"), whole.alias("invoice")))


@query(_RATERS + """, s AS (SELECT count(*) AS n, avg(CAST(a = b AS INT)) AS accuracy, CAST(sum(CASE WHEN a = 'correct' AND b = 'correct' THEN 1 ELSE 0 END) AS DOUBLE) AS tp, sum(CASE WHEN b = 'correct' THEN 1 ELSE 0 END) AS said, sum(CASE WHEN a = 'correct' THEN 1 ELSE 0 END) AS t FROM two)
  SELECT n, round(accuracy, 9) AS accuracy, round(tp / said, 9) AS precision, round(tp / t, 9) AS recall, round(2 * (tp / said) * (tp / t) / (tp / said + tp / t), 9) AS f1, round((accuracy - pe) / (1 - pe), 9) AS kappa FROM (SELECT s.*, (said * t + (n - said) * (n - t)) / (CAST(n AS DOUBLE) * n) AS pe FROM s) y""")
def binary_report(spark, sf_dir):
    return review.binary_report(_raters(spark, sf_dir)).select("n", *_r("accuracy", "precision", "recall", "f1", "kappa"))


_GRADED = COMPARED + ", v AS (SELECT id, id % 50 = 0 AS human, f1 >= 0.95 AS second FROM sc), u AS (SELECT count(*) FILTER (NOT human) AS n_unverified FROM v) "


@query(_GRADED + """SELECT 'silver' AS mode, (SELECT count(*) FROM v WHERE second) AS n, 'SILVER (cross-model agreement)' AS grade, n_unverified FROM u
  UNION ALL SELECT 'human', (SELECT count(*) FROM v WHERE human), 'DEV_ONLY_teacher_labeled', n_unverified FROM u UNION ALL SELECT 'all', (SELECT count(*) FROM v), 'DEV_ONLY_teacher_labeled', n_unverified FROM u
  UNION ALL SELECT 'verified', (SELECT count(*) FROM v WHERE human), 'human_verified', 0 FROM u""")
def usable_gold(spark, sf_dir):
    """How many rows may be scored, and by which grade, in four settings (the last over verified rows alone)."""
    rows = keep(review.silver(_scores(spark, sf_dir)).withColumn("human_verified", F.col("id") % 50 == 0), "graded")
    forms = {"silver": review.usable_gold(rows, silver_only=True), "human": review.usable_gold(rows), "all": review.usable_gold(rows, allow_unverified=True), "verified": review.usable_gold(rows.where("human_verified"))}
    out = None
    for mode, df in forms.items():
        one = df.groupBy(F.lit(mode).alias("mode"), "grade", "n_unverified").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(COMPARED + """, v AS (SELECT id, id % 50 = 0 AS human, f1 >= 0.95 AS second FROM sc)
  SELECT count(*) AS n, count(*) FILTER (human) AS human, count(*) FILTER (second) AS silver, count(*) FILTER (NOT human AND NOT second) AS unverified, CASE WHEN bool_and(human) THEN 'human' WHEN bool_or(second) THEN 'silver' ELSE 'unverified' END AS grade FROM v""")
def gold_grade(spark, sf_dir):
    scores = review.silver(_scores(spark, sf_dir))
    return review.gold_grade(scores.withColumn("human_verified", F.col("id") % 50 == 0))


@query(COMPARED + """, t AS (SELECT unnest([NULL, 0.99::DOUBLE, 1.2::DOUBLE, 0::DOUBLE]) AS teacher), m AS (SELECT avg(f1) AS f1 FROM sc)
  SELECT teacher, round(CASE WHEN teacher IS NULL THEN f1 WHEN teacher <> 0 THEN f1 / teacher ELSE 0 END, 9) AS ratio, CASE WHEN teacher IS NULL THEN f1 WHEN teacher <> 0 THEN f1 / teacher ELSE 0 END >= 0.95 AS meets_bar FROM t, m""")
def quality_gate(spark, sf_dir):
    """By a teacher that isn't scored, one that is, one that the student falls short of, and one that scored nothing."""
    student = extraction.batch_scores(_scores(spark, sf_dir)).select("f1_macro")
    rows = student.withColumn("teacher", F.explode(F.array(F.lit(None).cast("double"), F.lit(0.99), F.lit(1.2), F.lit(0.0))))
    return rows.select("teacher", review.quality_bar(F.col("f1_macro"), F.col("teacher")).alias("q")).select("teacher", F.round("q.ratio", PLACES).alias("ratio"), "q.meets_bar")


@query("""WITH k AS (SELECT count(*) AS n FROM orders), c AS (SELECT n, CAST(floor(n * 0.72) AS BIGINT) AS train, CAST(floor(n * 0.1) AS BIGINT) AS dev FROM k)
  SELECT 'train' AS split, train AS n FROM c UNION ALL SELECT 'dev', dev FROM c UNION ALL SELECT 'gold', 60 FROM c UNION ALL SELECT 'agreement', 30 FROM c UNION ALL SELECT 'test', n - train - dev - 90 FROM c""")
def split_counts(spark, sf_dir):
    return random_split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query(SQL + " SELECT h.id, 'vendor,date,currency,line_items,subtotal,tax,grand_total,payment_terms' AS keys, h.vendor, round(grand_total, 2) AS grand_total, m AS lines FROM h")
def canonical_form(spark, sf_dir):
    """Canonical JSON of every invoice: its keys in order, and what is read back from it."""
    text = gate.canonical_json(F.col("gold"))
    rows = gold(spark, sf_dir).select("id", text.alias("j"))
    value = lambda path, kind: F.try_variant_get(F.parse_json("j"), path, kind)
    return rows.select("id", F.array_join(F.json_object_keys("j"), ",").alias("keys"), value("$.vendor", "string").alias("vendor"), F.round(value("$.grand_total", "double"), 2).alias("grand_total"), F.json_array_length(F.get_json_object("j", "$.line_items")).cast("long").alias("lines"))


@query(SQL + """, c AS (SELECT path, count(*) FILTER (s IS NOT NULL OR n IS NOT NULL) AS filled FROM gold_f GROUP BY 1 UNION ALL SELECT 'line_items', count(*) FROM h)
  SELECT t.*, filled FROM (VALUES ('vendor', true, 'string'), ('date', true, 'string'), ('currency', true, 'string'), ('line_items', true, 'array'), ('subtotal', true, 'number'), ('tax', true, 'number'), ('grand_total', true, 'number'), ('payment_terms', false, 'string,null')) t(field, required, kind) JOIN c ON c.path = t.field""")
def contract_schema(spark, sf_dir):
    """The contract's fields, and in how many invoices each has a value."""
    schema = gate.json_schema()
    kind = lambda x: x if isinstance(x, str) else ",".join(x)
    fields = spark.createDataFrame([(n, n in schema["required"], kind(p["type"])) for n, p in schema["properties"].items()], "field string, required boolean, kind string")
    one = gold(spark, sf_dir).agg(*[F.count(F.col("gold")[n]).alias(n) for n in schema["properties"]])
    filled = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("filled")) for n in schema["properties"]])))
    return fields.join(filled, "field")


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS balance FROM customer")
def jsonl_round_trip(spark, sf_dir):
    """JSON lines written, put in place of themselves, and read."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("balance"))
    path = new_path(spark, "jsonl")
    schema = "id long, name string, balance double"
    files.write_jsonl(rows.withColumn("name", F.concat("name", F.lit("\n¶"))), path)
    back = files.read_jsonl(spark, path, schema)
    files.rewrite(back.withColumn("name", F.substring_index("name", "\n", 1)), path)
    return files.read_jsonl(spark, path, schema)


@query("""WITH l AS (SELECT doc_id % 8 AS bucket, CASE WHEN doc_id % 50 = 3 THEN '{"id": ' WHEN doc_id % 7 <> 1 THEN '{"id":' || doc_id || '}' END AS value, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) AS line FROM documents)
  SELECT bucket, line, value FROM l WHERE value NOT LIKE '%}'""")
def bad_json_lines(spark, sf_dir):
    """Lines cut short among good and blank ones, in eight files, told by file and line."""
    k = F.col("doc_id")
    value = F.when(k % 50 == 3, '{"id": ').when(k % 7 == 1, "").otherwise(F.concat(F.lit('{"id":'), k, F.lit("}")))
    rows = table(spark, sf_dir, "documents").select((k % 8).alias("bucket"), "doc_id", value.alias("value"))
    path = new_path(spark, "lines")
    rows.repartition(8, "bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "value").write.partitionBy("bucket").text(path)
    return files.bad_lines(spark, path).select(F.regexp_extract("file", "bucket=([0-9]+)", 1).cast("long").alias("bucket"), "line", "value")


@query(SQL + f" SELECT id, {_REASON} AS drop_reason, CASE WHEN id % 3 < 2 THEN 0 ELSE 1 END AS batch FROM h")
def incremental_gate(spark, sf_dir):
    """A folder of records that grows between two runs: each run takes the new files through the gate, once."""
    records = keep(_replies(spark, sf_dir).select("id", gate.first_json(F.col("reply")).alias("output")), "records")
    folder, out, state = (new_path(spark, x) for x in ("incoming", "gated", "progress"))
    for part in ("id % 3 < 2", "id % 3 = 2"):
        records.where(part).write.mode("append").json(folder)
        told = incremental.gate_new(spark, folder, out, state, "id long, output string", files_a_batch=100_000)
    return told.select("id", F.col("_drop_reason").alias("drop_reason"), "batch")


@query("""WITH k AS (SELECT DISTINCT event_type || '-' || (user_id % 500) AS key, event_id % 3 < 2 AS first FROM events) SELECT key, upper(key) AS reply, bool_or(first) AS cached, false AS failed FROM k GROUP BY 1""")
def memoised_calls(spark, sf_dir):
    """Two runs over one folder of replies: the second calls only for keys that the first didn't have."""
    key = F.concat("event_type", F.lit("-"), (F.col("user_id") % 500).cast("string"))
    asked = table(spark, sf_dir, "events").select(key.alias("key"), "event_id")
    folder = new_path(spark, "replies")
    live.memoised(asked.where("event_id % 3 < 2").select("key"), lambda row: row["key"].upper(), folder, pieces=2)
    return live.memoised(asked.select("key").distinct(), lambda row: row["key"].upper(), folder, pieces=2).select("key", "reply", "cached", F.col("error").isNotNull().alias("failed"))


@query(SQL + " SELECT id, id % 2 = 0 OR id % 3 = 0 AS valid, CAST(CASE WHEN id % 2 = 0 THEN 2 ELSE 3 END AS BIGINT) AS attempts, CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN vendor END AS vendor, CASE WHEN NOT (id % 2 = 0 OR id % 3 = 0) THEN 'no JSON found' END AS error FROM h")
def live_labels(spark, sf_dir):
    """A stub that answers some documents at the second attempt and some at the third, asked until it does."""
    seeds = gold(spark, sf_dir).select("id", F.to_json("gold").alias("text"))

    def call(row: dict) -> str:
        good = row["id"] % 2 == 0 if row["attempt"] == 2 else row["attempt"] == 3 and row["id"] % 3 == 0
        return row["messages"][1]["content"].split("\n", 1)[1].rsplit("\n</document>", 1)[0] if good else "none"

    log = live.labelled(seeds, call, new_path(spark, "live"), "S", pieces=2)
    return calls.resolve(log).select("id", "valid", "attempts", F.col("invoice.vendor").alias("vendor"), "error")


@query(SQL + """, n AS (SELECT id, count(*) AS n FROM gold_f GROUP BY 1),
  f AS (SELECT h.id, CASE WHEN h.id % 4 = 1 THEN CASE h.id % 9 WHEN 2 THEN 'no JSON found' WHEN 3 THEN 'extra:note' WHEN 4 THEN 'missing:date' WHEN 6 THEN 'empty:line_items' WHEN 7 THEN 'not_object' WHEN 8 THEN 'type:tax' END END AS told,
    CASE WHEN h.id % 9 = 5 AND abs(round(h.grand_total, 2) - 1234.5) > 0.01 THEN (CAST(n AS DOUBLE) - 1) / n ELSE CAST(1 AS DOUBLE) END AS f1 FROM h JOIN n USING (id))
  SELECT id, id % 4 AS part, CASE WHEN id % 4 = 1 THEN told IS NULL AND f1 >= CAST(0.95 AS DOUBLE) END AS silver_verified, CASE WHEN id % 4 = 1 THEN 'other' END AS silver_model, CASE WHEN id % 4 = 1 THEN CASE WHEN told IS NULL THEN round(f1, 4) ELSE 0 END END AS silver_field_f1, 'verifier-invalid: ' || told AS silver_note FROM f""")
def silver_merge(spark, sf_dir):
    """What a second model says of a quarter of the invoices, merged into the table of all, one partition of which is
    written again."""
    replies = keep(_replies(spark, sf_dir).where("id % 4 = 1").select("id", "gold", "reply"), "second")
    path = new_path(spark, "gold")
    gold(spark, sf_dir).select("id", (F.col("id") % 4).alias("part"), "gold.vendor").write.partitionBy("part").parquet(path)
    files.upsert(review.silver_fields(replies, "other"), path, "part")
    out = spark.read.option("mergeSchema", True).parquet(path)
    return out.select("id", F.col("part").cast("long").alias("part"), "silver_verified", "silver_model", "silver_field_f1", "silver_note")


@query("SELECT 'seed-' || substr(sha256(n_name), 1, 16) AS id, n_name AS text FROM nation")
def text_folder(spark, sf_dir):
    path = new_path(spark, "texts")
    table(spark, sf_dir, "nation").select(F.concat(F.lit(" \t"), "n_name", F.lit("\xa0"))).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_seeds(spark, path).select("id", "text")


@query("SELECT doc_id AS id, CASE quality WHEN 1 THEN 'correct' ELSE CASE WHEN toxic = 1 THEN NULL ELSE 'incorrect' END END AS label, 'line one' || chr(10) || 'and \"two\", of ' || doc_id AS notes FROM labels")
def rating_sheet(spark, sf_dir):
    """A filled sheet, written and read: labels by their aliases, one that is none, and notes of two lines."""
    said = F.when(F.col("quality") == 1, " OK").when(F.col("toxic") == 1, "perhaps").otherwise("WRONG")
    notes = F.concat(F.lit('line one\nand "two", of '), "doc_id")
    path = new_path(spark, "sheet")
    files.write_sheet(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), said.alias("label"), notes.alias("notes")), path)
    return files.read_ratings(spark, path).select(F.col("id").cast("long").alias("id"), "label", "notes")


@query(_RATERS + "SELECT id, a AS label FROM two WHERE a <> b")
def settled_sheet(spark, sf_dir):
    """The queue of disagreements, settled in favour of the first rater, and read as gold labels."""
    path, done = new_path(spark, "queue"), new_path(spark, "settled")
    files.write_queue(rater_disagreements(spark, sf_dir), path)
    queue = spark.read.csv(path, header=True)
    files.write_sheet(queue.select("id", F.col("rater_a").alias("label")), done, ("id", "label"))
    return files.read_settled(spark, done).select(F.col("id").cast("long").alias("id"), "label")


@query(ORACLE_SQL["usage_report"])
def report_file(spark, sf_dir):
    """A report written as JSON and read."""
    path = new_path(spark, "report")
    report = usage_report(spark, sf_dir)
    files.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("SELECT lang, count(*) AS n, 'auto' AS method, true AS below FROM documents WHERE length(text) >= 1500 GROUP BY 1")
def settings_file(spark, sf_dir):
    """Settings of a file, changed in depth, applied to the documents; and a path taken from the project's folder."""
    with tempfile.TemporaryDirectory() as top:
        at = Path(top).resolve()
        (at / "pyproject.toml").touch()
        (at / "a").mkdir()
        (at / "a" / "s.json").write_text('{"dedup": {"method": "jaccard"}, "filter": {"least": 1500, "most": 9}, "paths": {"out": "b/c"}}')
        found = files.read_settings(at / "a" / "s.json", {"dedup": {"method": "auto"}, "filter": {"most": 10}})
        below = files.resolve_path(found, "out") == at / "b" / "c"
    long = table(spark, sf_dir, "documents").where(F.length("text") >= found["filter"]["least"])
    return long.groupBy("lang").agg(F.count("*").alias("n"), F.lit(found["dedup"]["method"]).alias("method"), F.lit(below).alias("below"))


@query("""SELECT doc_id AS id, p.pass, p.salt FROM documents, (VALUES (1, ''), (2, 'consistency')) p(pass, salt)""")
def two_passes(spark, sf_dir):
    return calls.two_passes(_texts(spark, sf_dir)).select("id", "pass", "salt")


@query(SQL + " SELECT id, CAST(2 AS BIGINT) AS attempt, true AS constrained, CAST(0.3 AS DOUBLE) AS temperature, 4 AS turns, 'no JSON found' AS told FROM h WHERE id % 2 = 1 UNION ALL SELECT id, 1, false, 0.0, 2, NULL FROM h WHERE id % 2 = 0")
def next_requests(spark, sf_dir):
    """What to ask next where half of the documents have had one refused reply."""
    seeds = gold(spark, sf_dir).select("id", F.col("gold.vendor").alias("text"))
    log = seeds.where("id % 2 = 1").select("id", F.lit(1).alias("attempt"), F.lit("none").alias("reply"))
    asked = calls.next_requests(seeds, log, "S")
    told = F.regexp_extract(F.get("messages", F.lit(3))["content"], "not accepted: ([^\n]*)", 1)
    return asked.select("id", "attempt", "constrained", "temperature", F.size("messages").alias("turns"), F.when(F.size("messages") == 4, told).alias("told"))


@query(SQL + " SELECT id, vendor FROM h WHERE id % 2 = 0")
def extracted(spark, sf_dir):
    """The raising form over logs that end well."""
    log = gold(spark, sf_dir).where("id % 2 = 0").select("id", F.inline(F.array(F.struct(F.lit(1).alias("attempt"), F.lit("none").alias("reply")), F.struct(F.lit(2).alias("attempt"), F.to_json("gold").alias("reply")))))
    return calls.extracted(log).select("id", "invoice.vendor")


@query("SELECT event_id % 50 AS key, 'r' || (event_id % 50) AS reply FROM events GROUP BY 1")
def calls_made(spark, sf_dir):
    """Calls through the boundary, each key once; the first two tries of some fail with errors that pass."""

    def call(row: dict) -> str:
        if random.random() < 0.2:
            raise ConnectionError("reset")
        return f"r{row['key']}"

    asked = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("key"))
    return calls.made(asked, call, tries=40, base=0.0, most=0.0).select(F.col("key").cast("long").alias("key"), "reply")
