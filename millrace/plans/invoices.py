"""Invoices derived from the order tables, a deterministically damaged copy, and the joined field table.

Each is also given as SQL (CTEs for an oracle), written from the rules, not from the DataFrame form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENCIES = ("USD", "EUR", "GBP", "PKR", "INR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, gold (struct): one invoice per order with lines. Lines move twice: to their part (unless it is broadcast), and
    to their order, where one sorted list is made of them."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    item = F.struct(*order, F.col("p_name").alias("description"), F.col("l_quantity").alias("qty"), cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_extendedprice").alias("total"))
    money = lambda c: F.sum(cents(c).cast("decimal(18,2)")).cast("double")
    by = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"), money(F.col("l_extendedprice")).alias("subtotal"), money(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"))
    head = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    money_in = F.array(*map(F.lit, CURRENCIES))
    terms = F.when(F.col("o_orderpriority") == "1-URGENT", "Due on receipt").when(F.col("o_orderpriority") != "5-LOW", "Net 30")
    items = F.transform("items", lambda x: F.struct(x.description.alias("description"), x.qty.cast("double").alias("qty"), x.unit_price.alias("unit_price"), x.total.alias("total")))
    invoice = F.struct(F.col("c_name").alias("vendor"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.element_at(money_in, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("currency"), items.alias("line_items"), F.col("subtotal"), F.col("tax"), (F.col("subtotal") + F.col("tax")).alias("grand_total"), terms.alias("payment_terms"))
    return head.join(by, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), invoice.alias("gold"))


def predicted(invoices: DataFrame) -> DataFrame:
    """Adds pred (null where k % 29 = 0), damaged by rules on k = id."""
    k, g = F.col("id"), F.col("gold")
    items = F.when(k % 7 == 1, F.slice(g["line_items"], 1, F.greatest(F.size(g["line_items"]) - 1, F.lit(0)))).otherwise(g["line_items"])
    extra = F.struct(F.lit("Subtotal").alias("description"), F.lit(1.0).alias("qty"), g["subtotal"].alias("unit_price"), g["subtotal"].alias("total"))
    items = F.when(k % 11 == 2, F.concat(items, F.array(extra))).otherwise(items)
    items = F.when(k % 13 == 4, F.transform(items, lambda x, i: x.withField("qty", x.qty + F.when(i == 0, 1.0).otherwise(0.0)))).otherwise(items)
    pred = g.withField("line_items", items)
    pred = pred.withField("grand_total", g["grand_total"] + F.when(k % 5 == 3, 0.02).when(k % 5 == 4, 0.005).otherwise(0.0))
    pred = pred.withField("date", F.when(k % 17 == 5, F.date_format(F.date_add(g["date"].cast("date"), 1), "yyyy-MM-dd")).otherwise(g["date"]))
    pred = pred.withField("currency", F.when(k % 19 == 6, "XXX").otherwise(g["currency"]))
    pred = pred.withField("vendor", F.when(k % 19 == 7, F.replace(F.upper(g["vendor"]), F.lit(" "), F.lit("  "))).otherwise(g["vendor"]))
    pred = pred.withField("payment_terms", F.when(k % 23 == 8, F.when(g["payment_terms"].isNull(), "Net 30")).otherwise(g["payment_terms"]))
    return invoices.withColumn("pred", F.when(k % 29 != 0, pred))


#: gold_f and pred_f (id, path, leaf, s, n): the fields of both sides; ids (id, pred_null).
SQL = """
WITH l0 AS (
  SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS pos, p_name
  FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey),
sums AS (SELECT l_orderkey AS id, count(*) AS m,
  CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) / 100 AS DECIMAL(18,2))) AS DOUBLE) AS subtotal,
  CAST(sum(CAST(floor(l_extendedprice * l_tax * 100 + 0.5) / 100 AS DECIMAL(18,2))) AS DOUBLE) AS tax FROM l0 GROUP BY 1),
h AS (SELECT o_orderkey AS id, c_name AS vendor, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS next_date,
  list_extract(['USD','EUR','GBP','PKR','INR'], CAST(n_nationkey % 5 + 1 AS INT)) AS currency, m, subtotal, tax, subtotal + tax AS grand_total,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Due on receipt' WHEN o_orderpriority <> '5-LOW' THEN 'Net 30' END AS terms
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN sums ON sums.id = o_orderkey),
ids AS (SELECT id, id % 29 = 0 AS pred_null FROM h),
li AS (SELECT l_orderkey AS id, pos, p_name AS description, CAST(l_quantity AS DOUBLE) AS qty, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS unit_price, l_extendedprice AS total FROM l0 WHERE l_orderkey IN (SELECT id FROM h)),
pl0 AS (SELECT li.* FROM li JOIN h USING (id) WHERE NOT (li.id % 7 = 1 AND pos = m - 1)
  UNION ALL SELECT id, CASE WHEN id % 7 = 1 THEN m - 1 ELSE m END, 'Subtotal', 1.0, subtotal, subtotal FROM h WHERE id % 11 = 2),
pl AS (SELECT id, pos, description, qty + CASE WHEN id % 13 = 4 AND pos = 0 THEN 1.0 ELSE 0.0 END AS qty, unit_price, total FROM pl0 WHERE id % 29 <> 0),
ph AS (SELECT id, CASE WHEN id % 19 = 7 THEN replace(upper(vendor), ' ', '  ') ELSE vendor END AS vendor, CASE WHEN id % 17 = 5 THEN next_date ELSE date END AS date,
  CASE WHEN id % 19 = 6 THEN 'XXX' ELSE currency END AS currency, subtotal, tax,
  grand_total + CASE WHEN id % 5 = 3 THEN CAST(0.02 AS DOUBLE) WHEN id % 5 = 4 THEN CAST(0.005 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS grand_total,
  CASE WHEN id % 23 = 8 THEN CASE WHEN terms IS NULL THEN 'Net 30' END ELSE terms END AS terms FROM h WHERE id % 29 <> 0),
gold_f AS (@FIELDS(h, li)@), pred_f AS (@FIELDS(ph, pl)@)
"""


def _fields(head: str, lines: str) -> str:
    top = [f"SELECT id, '{path}' AS path, '{path}' AS leaf, {col} AS s, CAST(NULL AS DOUBLE) AS n FROM {head}" for path, col in (("vendor", "vendor"), ("date", "date"), ("currency", "currency"), ("payment_terms", "terms"))]
    top += [f"SELECT id, '{c}', '{c}', NULL, {c} FROM {head}" for c in ("subtotal", "tax", "grand_total")]
    top += [f"SELECT id, 'line_items[' || pos || '].{c}', '{c}', {'description' if c == 'description' else 'NULL'}, {'NULL' if c == 'description' else c} FROM {lines}" for c in ("description", "qty", "unit_price", "total")]
    return " UNION ALL ".join(top)


SQL = SQL.replace("@FIELDS(h, li)@", _fields("h", "li")).replace("@FIELDS(ph, pl)@", _fields("ph", "pl")).strip()

#: Adds cmp: the compared fields.
COMPARED = SQL + """,
cmp0 AS (SELECT coalesce(p.id, g.id) AS id, coalesce(p.path, g.path) AS path, coalesce(p.leaf, g.leaf) AS leaf, p.id IS NOT NULL AS has_pred, g.id IS NOT NULL AS has_gold,
  p.s AS ps, p.n AS pn, g.s AS gs, g.n AS gn FROM pred_f p FULL OUTER JOIN gold_f g ON p.id = g.id AND p.path = g.path),
cmp AS (SELECT *, CASE WHEN ps IS NULL AND pn IS NULL AND gs IS NULL AND gn IS NULL THEN true
  WHEN (ps IS NULL AND pn IS NULL) OR (gs IS NULL AND gn IS NULL) THEN false
  WHEN pn IS NOT NULL AND gn IS NOT NULL THEN abs(pn - gn) <= CASE WHEN leaf = 'qty' THEN CAST(0.0001 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END
  ELSE coalesce(lower(trim(regexp_replace(ps, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(gs, '\\s+', ' ', 'g'))), false) END AS same FROM cmp0),
sc0 AS (SELECT id, sum(CASE WHEN same AND has_pred AND has_gold THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN has_pred AND NOT (same AND has_gold) THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN has_gold AND NOT (same AND has_pred) THEN 1 ELSE 0 END) AS fn, bool_and(same AND has_pred AND has_gold) AS every, count(*) AS m FROM cmp GROUP BY id),
sc1 AS (SELECT ids.id, pred_null, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(every, true) AND NOT pred_null AS exact,
  CASE WHEN pred_null OR m IS NULL THEN 0.0 ELSE CAST(tp AS DOUBLE) / m END AS agreement,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS r FROM ids LEFT JOIN sc0 USING (id)),
sc AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM sc1)
"""
