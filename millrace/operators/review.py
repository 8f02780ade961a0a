"""Operators of the human loop: allocation, stratified sampling, rater agreement, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.extraction import pair_scores
from millrace.operators.gate import first_json, validate


def informativeness(f1: Column, repaired: Column, exact: Column) -> Column:
    return (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), f1))) + 0.5 * repaired.cast("int") + 0.5 * (~exact).cast("int")


def allocate(strata: DataFrame, n: int) -> DataFrame:
    """strata: stratum, size (one row each). Adds alloc by largest remainders; ties by size, then name, descending."""
    every = Window.partitionBy()
    quota = F.col("size") * F.lit(float(n)) / F.sum("size").over(every)
    out = strata.withColumn("quota", quota).withColumn("base", F.floor("quota"))
    order = Window.orderBy(F.desc(F.col("quota") - F.col("base")), F.desc("size"), F.desc("stratum"))
    extra = F.row_number().over(order) <= F.lit(n) - F.sum("base").over(every)
    enough = F.sum("size").over(every) <= n
    return out.select("stratum", "size", F.when(enough, F.col("size")).otherwise(F.col("base") + extra.cast("int")).cast("long").alias("alloc"))


def stratified_sample(items: DataFrame, n: int) -> DataFrame:
    """The alloc most informative items (id, stratum, informativeness) of each stratum, ties by id. No stratum gets more than
    n, so each task keeps n of each before rows move, and no task sorts a whole stratum."""
    plan = allocate(items.groupBy("stratum").agg(F.count("*").alias("size")), n)
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("informativeness"), "id"))
    first = items.withColumn("rank", rank).where(F.col("rank") <= n)
    return first.join(plan, "stratum").where("rank <= alloc").select("id", "stratum", "informativeness", F.col("rank").cast("long").alias("rank"))


def candidates(docs: DataFrame) -> DataFrame:
    """id, stratum, f1, exact, repaired, informativeness of docs (id, pred, gold: invoices, raw: the reply): repaired tells
    that there is a raw reply which doesn't pass the gate as it stands; the stratum is the currency of the prediction,
    else (without a prediction) of the gold, else UNK."""
    repaired = F.col("raw").isNotNull() & (F.size(validate(F.col("raw"))["errors"]) > 0)
    named = F.when(F.col("pred").isNotNull(), F.col("pred.currency")).otherwise(F.col("gold.currency"))
    ready = docs.select("id", "pred", "gold", F.coalesce(F.nullif(named, F.lit("")), F.lit("UNK")).alias("stratum"), repaired.alias("repaired"))
    out = pair_scores(ready, keep=("stratum", "repaired")).select("id", "stratum", "f1", "exact", "repaired")
    return out.withColumn("informativeness", informativeness(F.col("f1"), F.col("repaired"), F.col("exact")))


def limited(rows: DataFrame, by: str, n: int, order: str = "id") -> DataFrame:
    """The first n rows of each set, by order. Each task keeps n a set before rows move."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_rank") <= n).drop("_rank")


def aligned(a: DataFrame, b: DataFrame, order: str = "ord") -> DataFrame:
    """id, a, b of two raters' rows (id, label, ord): ids that both labelled, each by the last of its rows with a label.
    Both sides come down to one row an id before they meet."""
    last = lambda df, name: df.where("label is not null and label <> ''").groupBy("id").agg(F.max_by("label", order).alias(name))
    return last(a, "a").join(last(b, "b"), "id")


def _agreement() -> list[Column]:
    return [F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("po")]


def _kappa(both: DataFrame, raw: DataFrame) -> DataFrame:
    """raw (one row with n and po, and more) with pe and kappa of both (a, b)."""
    labels = both.select(F.col("a").alias("label"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).union(both.select("b", F.lit(0), F.lit(1)))
    chance = labels.groupBy("label").agg(F.sum("in_a").alias("x"), F.sum("in_b").alias("y")).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    met = raw.crossJoin(F.broadcast(chance)).withColumn("pe", F.try_divide(F.col("xy").cast("double"), F.col("n").cast("double") * F.col("n")))  # one row by one
    close = F.abs(F.col("pe") - 1) <= 1e-9
    kappa = F.when(close, F.when(F.abs(F.col("po") - 1) <= 1e-9, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")))
    return met.withColumn("kappa", kappa).drop("xy")


def rater_scores(pairs: DataFrame) -> DataFrame:
    """One row: n, raw agreement, chance agreement and Cohen's kappa of labels a, b (rows with both)."""
    both = pairs.where("a is not null and b is not null")
    return _kappa(both, both.agg(*_agreement())).select("n", "po", "pe", "kappa")


def score_raters(a: DataFrame, b: DataFrame, labels: tuple[str, ...] = ("correct", "incorrect"), bar: float = 0.70, order: str = "ord") -> DataFrame:
    """One row over aligned() raters: n, po, kappa, n_disagreements, confusion (a map "a|b" to counts, zeros included) and
    verdict (PASS where kappa reaches the bar, else REVISE). Raters that share no item are an error."""
    both = aligned(a, b, order)
    cells = [(x, y) for x in labels for y in labels]
    counts = [F.count_if((F.col("a") == x) & (F.col("b") == y)).alias(f"c{i}") for i, (x, y) in enumerate(cells)]
    out = _kappa(both, both.agg(*_agreement(), F.count_if(F.col("a") != F.col("b")).alias("n_disagreements"), *counts))
    some = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("the raters share no rated item")).cast("long"))
    grid = F.create_map(*[x for i, (p, q) in enumerate(cells) for x in (F.lit(f"{p}|{q}"), F.col(f"c{i}"))])
    return out.select(some.alias("n"), "po", "kappa", "n_disagreements", grid.alias("confusion"), kappa_gate(F.col("kappa"), bar).alias("verdict"))


def kappa_gate(kappa: Column, bar: float = 0.70) -> Column:
    return F.when(kappa >= bar, "PASS").otherwise("REVISE")


def human_accuracy(labels: DataFrame) -> DataFrame:
    """One row over settled labels (label): n, human_verified_accuracy, n_correct, n_incorrect, precision_correct,
    recall_correct (1 by definition: every extraction was put forward as correct). No labels are an error."""
    good = F.coalesce(F.col("label") == "correct", F.lit(False))
    out = labels.agg(F.count("*").alias("n"), F.count_if(good).alias("n_correct"))
    some = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no gold labels")).cast("long"))
    share = F.try_divide("n_correct", "n")
    return out.select(some.alias("n"), share.alias("human_verified_accuracy"), "n_correct", (F.col("n") - F.col("n_correct")).alias("n_incorrect"), share.alias("precision_correct"), F.lit(1.0).alias("recall_correct"))


#: Labels that a confusion matrix may have, so that their pairs can be made from a broadcast.
MOST_LABELS = 1000


def confusion(pairs: DataFrame) -> DataFrame:
    """a, b, n over all pairs of labels that occur, zero where none. More than MOST_LABELS labels are an error."""
    both = pairs.where("a is not null and b is not null")
    labels = both.select(F.col("a").alias("l")).union(both.select("b")).distinct()
    found = labels.limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"a confusion matrix has at most {MOST_LABELS} labels")
    names = [r.l for r in found]
    grid = both.sparkSession.createDataFrame([(x, y) for x in names for y in names], f"a {labels.schema['l'].dataType.simpleString()}, b {labels.schema['l'].dataType.simpleString()}")
    return grid.join(both.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "left").na.fill(0, ["n"])


def split(rows: DataFrame, seed: int = 17, train: float = 0.72, dev: float = 0.10, gold: int = 60, agreement: int = 30, fine: int = 4096) -> DataFrame:
    """id, ordinal (by a hash of id and seed), split. Ordinals come from cells of the hash: counts of cells are summed
    first and rows ranked within a cell, so no task orders all rows."""
    keyed = rows.select("id", F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))).alias("h"))
    keyed = keyed.withColumn("cell", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    cells = keyed.groupBy("cell").agg(F.count("*").alias("c"))
    order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begun = cells.select("cell", F.coalesce(F.sum("c").over(order), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy()).alias("total"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("h", "id")) - 1
    out = keyed.withColumn("rank", rank).join(F.broadcast(begun), "cell").withColumn("ordinal", (F.col("before") + F.col("rank")).cast("long"))
    first, second = F.floor(F.col("total") * F.lit(train)), F.floor(F.col("total") * F.lit(dev))
    rest = F.col("ordinal") - first - second
    name = F.when(F.col("ordinal") < first, "train").when(rest < 0, "dev").when(rest < gold, "gold").when(rest < gold + agreement, "agreement").otherwise("test")
    return out.select("id", "ordinal", name.alias("split"))


def binary_report(pairs: DataFrame, positive: str = "correct") -> DataFrame:
    """One row: n, accuracy, precision, recall, f1 of b against a (the truth) for one label, and kappa; ratios without a
    base are 0."""
    both = pairs.where("a is not null and b is not null")
    hit, said, true = (F.col("a") == positive) & (F.col("b") == positive), F.col("b") == positive, F.col("a") == positive
    out = _kappa(both, both.agg(*_agreement(), F.count_if(hit).alias("tp"), F.count_if(said).alias("said"), F.count_if(true).alias("true")))
    out = out.withColumn("precision", F.coalesce(F.try_divide("tp", "said"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("tp", "true"), F.lit(0.0)))
    both_rates = F.col("precision") + F.col("recall")
    return out.select("n", F.coalesce("po", F.lit(0.0)).alias("accuracy"), "precision", "recall", F.when(both_rates > 0, 2 * F.col("precision") * F.col("recall") / both_rates).otherwise(0.0).alias("f1"), "kappa")


def printed_share(document: Column, invoice: Column) -> Column:
    """Share of an invoice's amounts that the document prints, with two places or without trailing zeros; 0 without any."""
    amounts = F.array_compact(F.concat(F.array(invoice["subtotal"], invoice["tax"], invoice["grand_total"]), F.coalesce(F.transform(invoice["line_items"], lambda x: x["total"]), F.array().cast("array<double>"))))
    shown = F.transform(amounts, lambda x: F.format_string("%.2f", x))
    low = F.lower(document)
    there = F.filter(shown, lambda t: low.contains(t) | low.contains(F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "")))
    return F.when(F.size(shown) > 0, F.size(there) / F.size(shown)).otherwise(0.0)


def rule_labels(rows: DataFrame, strict: float = 1.0, lenient: float = 0.6) -> DataFrame:
    """id, a (strict rater), b (lenient rater), settled (the lenient one where they differ) of rows (id, document,
    invoice); a null document or invoice is incorrect."""
    share = F.coalesce(printed_share(F.col("document"), F.col("invoice")), F.lit(0.0))
    name = lambda limit: F.when(F.col("share") >= limit, "correct").otherwise("incorrect")
    out = rows.select("id", share.alias("share")).select("id", name(strict).alias("a"), name(lenient).alias("b"))
    return out.withColumn("settled", F.col("b"))


def silver(scores: DataFrame, least: float = 0.95) -> DataFrame:
    """id, silver_field_f1, silver_verified from field scores against a second model (an invalid one has f1 0)."""
    return scores.select("id", F.round("f1", 4).alias("silver_field_f1"), (F.col("f1") >= least).alias("silver_verified"))


def silver_fields(rows: DataFrame, model: str, least: float = 0.95) -> DataFrame:
    """id, silver_verified, silver_model, silver_field_f1, silver_note of rows (id, gold: an invoice, reply: what a second
    model made of the document; error: why there is no reply, if the table has it). A reply without JSON that passes the
    gate is not verified, with f1 0 and a note that says why; else fields decide, and there is no note."""
    found = rows.withColumn("_json", first_json(F.col("reply"))).withColumn("_checked", validate(F.col("_json")))
    told = F.when(F.col("_json").isNull(), "no JSON found").when(F.size("_checked.errors") > 0, F.array_join("_checked.errors", ", "))
    failed = F.coalesce(*([F.col("error")] if "error" in rows.columns else []), told)
    ready = found.select("id", "gold", F.when(failed.isNull(), F.col("_checked.invoice")).alias("pred"), failed.alias("failed"))
    scores = ready.join(pair_scores(ready.where("failed is null").select("id", "pred", "gold")).select("id", "f1"), "id", "left")
    f1 = F.when(F.col("failed").isNull(), F.coalesce("f1", F.lit(0.0))).otherwise(0.0)
    note = F.when(F.col("failed").isNotNull(), F.concat(F.lit("verifier-invalid: "), F.substring("failed", 1, 60)))
    return scores.select("id", (F.col("failed").isNull() & (f1 >= least)).alias("silver_verified"), F.lit(model).alias("silver_model"), F.round(f1, 4).alias("silver_field_f1"), note.alias("silver_note"))


def silver_rate(fields: DataFrame) -> DataFrame:
    """One row of silver_fields(): n, verified, invalid, rate."""
    verified = F.count_if("silver_verified")
    return fields.agg(F.count("*").alias("n"), verified.alias("verified"), F.count_if(F.col("silver_note").isNotNull()).alias("invalid"), (verified / F.greatest(F.count("*"), F.lit(1))).alias("rate"))


# The grades of a gold set.
GRADES = ("SILVER (cross-model agreement)", "human_verified", "DEV_ONLY_teacher_labeled")


def usable_gold(rows: DataFrame, silver_only: bool = False, allow_unverified: bool = False) -> DataFrame:
    """The rows that may be scored, with grade and n_unverified (of all rows, not of those alone): in silver mode those
    that a second model agreed with, else those that people verified, or all where unverified ones are allowed. The grade
    of the set depends on all its rows; the two counts are broadcast, one row."""
    people = F.coalesce("human_verified", F.lit(False))
    whole = rows.agg(F.count_if(~people).alias("n_unverified")).withColumn("grade", F.lit(GRADES[0]) if silver_only else F.when(F.col("n_unverified") == 0, GRADES[1]).otherwise(GRADES[2]))
    kept = F.coalesce("silver_verified", F.lit(False)) if silver_only else people | F.lit(allow_unverified)
    return rows.where(kept).crossJoin(F.broadcast(whole))


def gold_grade(rows: DataFrame) -> DataFrame:
    """One row: n, verified by people, silver, unverified, and the grade that all rows support."""
    people, second = F.coalesce("human_verified", F.lit(False)), F.coalesce("silver_verified", F.lit(False))
    by = rows.agg(F.count("*").alias("n"), F.count_if(people).alias("human"), F.count_if(second).alias("silver"), F.count_if(~people & ~second).alias("unverified"))
    grade = F.when((F.col("n") > 0) & (F.col("human") == F.col("n")), "human").when(F.col("silver") > 0, "silver").otherwise("unverified")
    return by.withColumn("grade", grade)


def quality_bar(student: Column, teacher: Column, least: float = 0.95) -> Column:
    """struct(ratio, meets_bar); an unscored teacher counts as 1, and to one that scored 0 the ratio is 0."""
    by = F.coalesce(teacher, F.lit(1.0))
    ratio = F.when(by != 0, student / by).otherwise(F.lit(0.0) * student)
    return F.struct(ratio.alias("ratio"), F.coalesce(ratio >= least, F.lit(False)).alias("meets_bar"))
