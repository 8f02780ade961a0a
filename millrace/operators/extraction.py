"""Operators over extractions: flattening, field scores, agreement, error taxonomy, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.normalise import comparable, let, strip
from millrace.operators.gate import _NUMBERS, LINE_FIELDS, _kind, _object, _of_line, parsed, plain

MONEY = ("unit_price", "total", "subtotal", "tax", "grand_total")
_TEXT, _NUMBER = ("vendor", "date", "currency", "payment_terms"), ("subtotal", "tax", "grand_total")
#: How a number may be written in a text, as a float's constructor reads it (underscores between digits taken out later).
_FLOAT = r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$|^[+-]?(inf|infinity|nan)$"
_HEADS = ("vendor", "date", "currency", "subtotal", "tax", "grand_total", "payment_terms")


def _cell(x: Column, leaf: str) -> tuple[Column, Column]:
    """A typed field as (text, number)."""
    none = F.lit(None)
    return (x[leaf].cast("string"), none.cast("double")) if leaf in (*_TEXT, "description") else (none.cast("string"), x[leaf].cast("double"))


def float_in(text: Column) -> Column:
    """The number that a text is, white space around it aside; null for any other text (a cast would take 1d or 1f too)."""
    bare = strip(text)
    return F.when(bare.rlike(_FLOAT), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))


def _line_path(i: Column, leaf: str | Column) -> Column:
    return F.concat(F.lit("line_items["), i.cast("string"), F.lit("]."), F.lit(leaf))


def flatten(docs: DataFrame, column: str) -> DataFrame:
    """docs (id, column: invoice struct) to one row per field: id, path, leaf, s (text) or n (number). One scan, one
    generator: each row explodes into its own fields, so nothing is shuffled. A struct has all its top fields; a line that
    is null has none, and the lines after it keep their numbers."""
    x = F.col(column)
    field = lambda path, leaf, v: F.struct(path.alias("path"), F.lit(leaf).alias("leaf"), _cell(v, leaf)[0].alias("s"), _cell(v, leaf)[1].alias("n"))
    top = F.array(*[field(F.lit(c), c, x) for c in _HEADS])
    numbered = F.transform(F.coalesce(x["line_items"], F.array()), lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    lines = F.flatten(F.transform(F.filter(numbered, lambda y: y["v"].isNotNull()), lambda y: F.array(*[field(_line_path(y["i"], c), c, y["v"]) for c in LINE_FIELDS])))
    return docs.where(x.isNotNull()).select("id", F.inline(F.concat(top, lines)))


def _slots(text: Column) -> Column:
    """json_fields() in their places: an entry for each top field, and for each field of every line; null where there is
    none. What isn't an object is null. A plain() text is read by its schema, any other by its values."""
    entry = lambda path, leaf, text, number, nested: F.struct(path.alias("path"), F.lit(leaf).alias("leaf"), text.alias("s"), number.alias("n"), nested.alias("j"))
    none = F.lit(None)

    def placed(top: list[Column], lines: Column) -> Column:
        return let(F.array(*top), lambda first: F.concat(first, F.coalesce(F.flatten(lines), F.slice(first, 1, 0))))

    def typed(x: Column) -> Column:
        def field(path: Column, leaf: str, v: Column) -> Column:
            s, n = _cell(v, leaf)
            there = v.isNotNull() & (v[leaf].isNotNull() | x["whole"])
            return F.when(there, entry(path, leaf, s, n + F.lit(0.0), none.cast("string")))  # no negative zero

        lines = F.transform(x["v"]["line_items"], lambda y, i: F.array(*[field(_line_path(i, c), c, y) for c in LINE_FIELDS]))
        return placed([field(F.lit(c), c, x["v"]) for c in _HEADS], lines)

    def field(path: Column, leaf: str, m: Column) -> Column:
        def of_value(x: Column) -> Column:
            v, kind = x["v"], x["kind"]
            text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
            truth = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
            number = F.when(kind.isin(*_NUMBERS), F.try_variant_get(v, "$", "double")).otherwise(truth)
            nested = F.when(kind.isin("OBJECT", "ARRAY"), F.to_json(v))
            if leaf in (*MONEY, "qty"):
                return let(F.coalesce(number, float_in(text)), lambda n: entry(path, leaf, F.when(n.isNull(), text), n, nested))
            return entry(path, leaf, text, number, nested)

        told = let(F.try_element_at(m, F.lit(leaf)), lambda v: F.struct(v.alias("v"), _kind(v).alias("kind")))
        return F.when(F.map_contains_key(m, leaf), let(told, of_value))

    def of_object(m: Column) -> Column:
        items = F.try_variant_get(F.try_element_at(m, F.lit("line_items")), "$", "array<variant>")
        lines = F.transform(items, lambda x, i: let(_object(x), lambda own: F.array(*[field(_line_path(i, c), c, own) for c in LINE_FIELDS])))
        return F.when(m.isNotNull(), placed([field(F.lit(c), c, m) for c in _HEADS], lines))

    return let(plain(text), lambda x: F.when(x.isNotNull(), typed(x)).otherwise(let(_object(parsed(text)), of_object)))


def json_fields(text: Column) -> Column:
    """The fields of an invoice as JSON text, as an array with an entry for each that is there: path, leaf, s (text), n
    (number; truth values as 0 and 1) or j (JSON of anything else). A key that is missing has no entry, one that is null has
    one of nulls. Line items that aren't objects are left out and keep their numbers. Amounts and quantities given as text
    have n where they read as a number as they stand. What isn't an object is null."""
    return F.array_compact(_slots(text))


#: An object's fields, and those of a line, each as a VARIANT: null where the key is missing, a VOID where its value is null.
_OBJECT, _LINE = (f"struct<{','.join(f'{n}:variant' for n in names)}>" for names in ((*_HEADS, "line_items"), LINE_FIELDS))


def _read(docs: DataFrame, column: str) -> DataFrame:
    """id, x and v of docs (id, column: JSON text): plain() of a text, else its value."""
    told = docs.select("id", F.col(column).alias("text"), plain(F.col(column)).alias("x"))
    return told.select("id", "x", F.when(F.col("x").isNull(), parsed(F.col("text"))).alias("v"))


def _lines(x: Column, o: Column) -> Column:
    """The line items of one side, struct(t, v) each: typed, or a VARIANT a field; empty where there is no list."""
    typed = F.transform(x["v"]["line_items"], lambda y: F.struct(y.alias("t"), F.lit(None).cast(_LINE).alias("v")))
    loose = F.transform(F.try_variant_get(o["line_items"], "$", "array<variant>"), lambda y: F.struct(F.lit(None).cast(f"struct<{_of_line}>").alias("t"), F.try_variant_get(y, "$", _LINE).alias("v")))
    return F.coalesce(typed, loose, F.array())


def _cells(docs: DataFrame, sides: tuple[str, ...]) -> DataFrame:
    """docs (id, and x and v of _read() for each side, named after it) to a row for each field that a side has: path, leaf,
    and for each side s, n, j and there. Documents become rows of lines, and these rows of fields, before any value is
    looked at: so values are read by compiled code, while what stands within a lambda would be interpreted. Lists are made
    a step before they come apart, which keeps the code of each step below the 8,000 bytes that the JVM compiles."""
    opened = docs.select("id", *[F.col(f"{c}x") for c in sides], *[F.try_variant_get(f"{c}v", "$", _OBJECT).alias(f"{c}o") for c in sides])
    lines = F.arrays_zip(*[_lines(F.col(f"{c}x"), F.col(f"{c}o")).alias(c or "a") for c in sides])
    listed = opened.select("*", F.posexplode_outer(F.concat(F.array(F.lit(None)), lines)).alias("at", "line"))  # the first stands for the top fields

    names = (*_TEXT, *_NUMBER), LINE_FIELDS  # texts come first in both
    pick = lambda of: F.when(F.col("at") == 0, F.array(*of[0])).otherwise(F.array(*of[1]))
    none = F.lit(None)

    def side(c: str) -> list[Column]:
        """Lists of the texts, numbers and VARIANTs of a row's fields, and whether all fields are there."""
        x, line = F.col(f"{c}x"), F.col("line")[c or "a"]
        typed, loose = (x["v"], line["t"]), (F.col(f"{c}o"), line["v"])
        texts = [[t[n] for n in own if n in (*_TEXT, "description")] for t, own in zip(typed, names, strict=True)]
        numbers = [[none.cast("double") if n in (*_TEXT, "description") else t[n] for n in own] for t, own in zip(typed, names, strict=True)]
        values = [[v[n] for n in own] for v, own in zip(loose, names, strict=True)]
        every = F.coalesce(F.when(F.col("at") == 0, typed[0].isNotNull()).otherwise(typed[1].isNotNull()) & x["whole"], F.lit(False))
        return [pick(texts).alias(f"{c}s"), pick(numbers).alias(f"{c}n"), pick(values).alias(f"{c}v"), every.alias(f"{c}all")]

    rows = listed.select("id", "at", pick([list(map(F.lit, own)) for own in names]).alias("leaf"), *[y for c in sides for y in side(c)])
    parts = [f"{c}{k}" for c in sides for k in "snv"]
    cells = rows.select("id", "at", *[f"{c}all" for c in sides], F.inline_outer(F.arrays_zip("leaf", *parts)))  # outer: the plan adds no filter that computes all of it again
    there = lambda c: F.col(f"{c}all") | F.col(f"{c}s").isNotNull() | F.col(f"{c}n").isNotNull() | F.col(f"{c}v").isNotNull()
    cells = cells.select("id", "at", "leaf", *parts, *[there(c).alias(f"{c}there") for c in sides]).where(" or ".join(f"{c}there" for c in sides))
    path = F.when(F.col("at") == 0, F.col("leaf")).otherwise(_line_path(F.col("at") - 1, F.col("leaf")))
    keys = ["id", "path", "leaf"]
    out = cells.select("id", path.alias("path"), "leaf", *[y for c in sides for y in (f"{c}s", f"{c}n", f"{c}v", f"{c}there", F.when(F.col(f"{c}v").isNotNull(), _kind(F.col(f"{c}v"))).alias(f"{c}kind"))])
    told = lambda c, v, kind: [f"{c}s", f"{c}n", f"{c}there", F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).alias(f"{c}text"), F.when(kind.isin(*_NUMBERS), F.try_variant_get(v, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).alias(f"{c}number"), F.when(kind.isin("OBJECT", "ARRAY"), F.to_json(v)).alias(f"{c}j")]
    out = out.select(*keys, *[y for c in sides for y in told(c, F.col(f"{c}v"), F.col(f"{c}kind"))])
    amount = F.col("leaf").isin(*MONEY, "qty")
    number = lambda c: F.coalesce(F.col(f"{c}n") + 0.0, f"{c}number", F.when(amount, float_in(F.col(f"{c}text"))))  # no negative zero
    out = out.select(*keys, *[y for c in sides for y in (f"{c}s", f"{c}text", number(c).alias(f"{c}n"), f"{c}j", f"{c}there")])
    text = lambda c: F.coalesce(f"{c}s", F.when(~amount | F.col(f"{c}n").isNull(), F.col(f"{c}text")))
    values = F.struct("path", "leaf", *[y for c in sides for y in (text(c).alias(f"{c}s"), f"{c}n", f"{c}j", f"{c}there")])
    return out.select("id", F.inline_outer(F.array(values)))  # a filter above would else be pushed down, and compute all values again for itself


def flatten_json(docs: DataFrame, column: str) -> DataFrame:
    """docs (id, column: JSON text) to one row per field that is there: id and what json_fields() tells."""
    return _cells(_read(docs, column), ("",)).drop("there")


def compare(pred: DataFrame, gold: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Full outer join of fields by (id, path), with match: for sides in separate tables (compare_pairs for sides in one
    row). Present but null differs from missing in has_*."""
    nested = "j" in pred.columns and "j" in gold.columns
    side = lambda df, x: df.select("id", "path", F.col("leaf").alias(f"{x}leaf"), F.col("s").alias(f"{x}s"), F.col("n").alias(f"{x}n"), *([F.col("j").alias(f"{x}j")] if nested else []), F.lit(True).alias(f"has_{'pred' if x == 'p' else 'gold'}"))
    met = side(pred, "p").join(side(gold, "g"), ["id", "path"], "full_outer").withColumn("leaf", F.coalesce("pleaf", "gleaf"))
    met = met.withColumn("has_pred", F.coalesce("has_pred", F.lit(False))).withColumn("has_gold", F.coalesce("has_gold", F.lit(False)))
    return _matched(met.drop("pleaf", "gleaf"), tolerance, nested)


def records(docs: DataFrame, column: str) -> DataFrame:
    """id, fields: one row a document (JSON text in column), its value read once for compare_records()."""
    return _read(docs, column).select("id", F.struct("x", "v").alias("fields"))


def compare_records(pred: DataFrame, gold: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The rows of compare() for records() of two tables (one row an id each): documents are shuffled and meet, one row a
    document and side, and their fields meet within the row, place by place. Tables bucketed by id on both sides meet
    without a shuffle."""
    met = pred.select("id", F.col("fields").alias("p")).join(gold.select("id", F.col("fields").alias("g")), "id", "full_outer")
    both = met.select("id", *[F.col(c)[f].alias(f"{c}{f}") for c in "pg" for f in "xv"])
    return _matched(_cells(both, ("p", "g")).withColumnsRenamed({"pthere": "has_pred", "gthere": "has_gold"}), tolerance, True)


def compare_pairs(docs: DataFrame, pred: str = "pred", gold: str = "gold", keep: tuple[str, ...] = (), tolerance: float = 0.01) -> DataFrame:
    """The rows of compare() for docs (id, pred and gold: invoice structs, and columns to keep). Fields of both sides
    meet within the row, top fields by name and lines by position, so nothing is shuffled or computed twice."""
    p, g = F.col(pred), F.col(gold)

    def field(path: Column, leaf: str, a: Column, b: Column) -> Column:
        (ps, pn), (gs, gn) = _cell(a, leaf), _cell(b, leaf)
        return F.struct(path.alias("path"), F.lit(leaf).alias("leaf"), ps.alias("ps"), pn.alias("pn"), a.isNotNull().alias("has_pred"), gs.alias("gs"), gn.alias("gn"), b.isNotNull().alias("has_gold"))

    top = F.array(*[field(F.lit(c), c, p, g) for c in _HEADS])
    none = F.array()
    both = F.arrays_zip(F.coalesce(p["line_items"], none).alias("p"), F.coalesce(g["line_items"], none).alias("g"))
    lines = F.flatten(F.transform(both, lambda x, i: F.array(*[field(_line_path(i, c), c, x["p"], x["g"]) for c in LINE_FIELDS])))
    out = docs.select("id", *keep, p.isNull().alias("pred_null"), F.inline_outer(F.concat(top, lines))).where("has_pred or has_gold")  # outer: see flatten_json()
    return _matched(out, tolerance)


def _alike(a: Column, b: Column) -> Column:
    """Whether two texts compare as equal; those that are equal as they stand aren't folded."""
    return F.when(a == b, True).otherwise(comparable(a) == comparable(b))


def _same(ps: Column, pn: Column, gs: Column, gn: Column, limit: Column, text: bool) -> Column:
    """_matched()'s `same` for a typed field whose kind is known."""
    a, b, alike = (ps, gs, _alike(ps, gs)) if text else (pn, gn, F.abs(pn - gn) <= limit)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(alike)


def _matched(met: DataFrame, tolerance: float, nested: bool = False) -> DataFrame:
    none = lambda x: F.col(f"{x}s").isNull() & F.col(f"{x}n").isNull() & (F.col(f"{x}j").isNull() if nested else F.lit(True))
    limit = F.when(F.col("leaf") == "qty", 1e-4).otherwise(tolerance)
    number = F.abs(F.col("pn") - F.col("gn")) <= limit
    text = _alike(F.col("ps"), F.col("gs"))
    alike = F.coalesce(number, text, *([F.col("pj") == F.col("gj")] if nested else []), F.lit(False))
    amount = F.col("leaf").isin(*MONEY, "qty")  # these agree as numbers or not at all
    same = F.when(none("p") & none("g"), True).when(none("p") | none("g"), False).when(amount, F.coalesce(number, F.lit(False))).otherwise(alike)
    return met.withColumn("same", same).withColumn("match", F.col("same") & F.col("has_pred") & F.col("has_gold"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _scored(ids: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = ids.withColumn("precision", p).withColumn("recall", r)
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    out = out.withColumn("exact", ~F.col("pred_null") & F.coalesce("all", F.lit(True)))
    return out.withColumn("agreement", F.when(F.col("pred_null"), 0.0).otherwise(F.coalesce("agree", F.lit(0.0))))


_SCORES = ("tp", "fp", "fn", "precision", "recall", "f1", "exact", "agreement")


def _sums() -> list[Column]:
    n = lambda c: F.count_if(c).cast("long")
    return [n(F.col("match")).alias("tp"), n(F.col("has_pred") & ~F.col("match")).alias("fp"), n(F.col("has_gold") & ~F.col("match")).alias("fn"), F.bool_and("match").alias("all"), F.avg(F.col("match").cast("int")).alias("agree")]


def field_scores(ids: DataFrame, fields: DataFrame) -> DataFrame:
    """Per id: tp, fp, fn, precision, recall, f1, exact, agreement. ids: id, pred_null; an id without fields scores 0
    (exact where it has a prediction and no fields on either side)."""
    out = ids.join(fields.groupBy("id").agg(*_sums()), "id", "left").na.fill(0, ["tp", "fp", "fn"])
    return _scored(out).select("id", *_SCORES)


def _counts(pred: Column, gold: Column, leaves: tuple[str, ...], tolerance: float) -> Column:
    """struct(tp, p, g, n): of a struct's fields on both sides those that agree, those of either side, and of any."""
    (has_p, has_g), size = (pred.isNotNull(), gold.isNotNull()), F.lit(len(leaves))
    same = lambda c: _same(*_cell(pred, c), *_cell(gold, c), F.lit(1e-4 if c == "qty" else tolerance), c in (*_TEXT, "description"))
    hits = [F.when(has_p & has_g & same(c), 1).otherwise(0) for c in leaves]
    of = lambda there: F.when(there, size).otherwise(0)
    return F.struct(sum(hits[1:], hits[0]).alias("tp"), of(has_p).alias("p"), of(has_g).alias("g"), of(has_p | has_g).alias("n"))


def pair_scores(docs: DataFrame, pred: str = "pred", gold: str = "gold", keep: tuple[str, ...] = (), tolerance: float = 0.01) -> DataFrame:
    """field_scores() of docs (id, pred, gold, and columns to keep, one value an id). An id without a struct on either side
    has no row. Top fields are counted before lines come apart, and each line then counts its own, so a document becomes a
    row a line, not a row a field; they are summed up in the task that made them, and one row an id is shuffled."""
    p, g = F.col(pred), F.col(gold)
    none = F.array()
    both = F.arrays_zip(F.coalesce(p["line_items"], none).alias("p"), F.coalesce(g["line_items"], none).alias("g"))
    tops = docs.where(p.isNotNull() | g.isNotNull()).select("id", *keep, p.isNull().alias("pred_null"), _counts(p, g, _HEADS, tolerance).alias("top"), both.alias("both"))
    rows = tops.select("id", *keep, "pred_null", "top", F.posexplode_outer("both").alias("at", "line"))
    line = _counts(F.col("line.p"), F.col("line.g"), LINE_FIELDS, tolerance)
    counted = rows.select("id", *keep, "pred_null", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("top")).alias("top"), line.alias("line"))
    total = lambda c: F.sum(F.coalesce(f"top.{c}", F.lit(0)) + F.col(f"line.{c}"))
    by = counted.groupBy("id", *keep).agg(F.bool_or("pred_null").alias("pred_null"), *[total(c).alias(c) for c in ("tp", "p", "g", "n")])
    told = by.select("id", *keep, "pred_null", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), (F.col("tp") == F.col("n")).alias("all"), (F.col("tp") / F.col("n")).alias("agree"))
    return _scored(told).select("id", *keep, *_SCORES)


def one_to_one(preds: DataFrame, golds: DataFrame, order: str = "at") -> DataFrame:
    """preds (at, pred) next to golds (at, gold) of the same place. A place that one side lacks, or has twice, is an error,
    as is a pair of empty tables."""
    side = lambda df, name: df.groupBy(order).agg(F.count("*").alias(f"n_{name}"), F.first(name).alias(name))
    met = side(preds, "pred").join(side(golds, "gold"), order, "full_outer")
    fits = (F.coalesce("n_pred", F.lit(0)) == 1) & (F.coalesce("n_gold", F.lit(0)) == 1)
    told = F.raise_error(F.concat(F.lit("no pair at place "), F.col(order).cast("string"))).cast("boolean")
    if met.isEmpty():
        raise ValueError("no predictions")
    return met.where(F.when(fits, F.lit(True)).otherwise(told)).select(order, "pred", "gold")


def batch_scores(scores: DataFrame, valid: Column | None = None) -> DataFrame:
    """One row over field scores: macro means, micro f1, exact rate, and schema_valid_rate where valid (a truth value a
    row: whether the raw reply passes the gate, or that there is a prediction) is given. Without rows it is an error."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    micro_p, micro_r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    some = F.when(F.count("*") > 0, F.count("*")).otherwise(F.raise_error(F.lit("no documents to score")).cast("long"))
    more = [] if valid is None else [F.avg(valid.cast("int")).alias("schema_valid_rate")]
    return scores.agg(some.alias("n"), F.avg("f1").alias("f1_macro"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), ratio(2 * micro_p * micro_r, micro_p + micro_r).alias("f1_micro"), F.avg(F.col("exact").cast("int")).alias("exact_rate"), F.avg("agreement").alias("agreement"), *more)


def categorise(fields: DataFrame) -> DataFrame:
    """Adds category to compared fields, typed or raw; null where values agree. A missing field counts as null here, a
    nested value (pj, gj) doesn't."""
    line = F.col("path").startswith("line_items[")
    none = lambda x: F.coalesce(*[F.col(c).cast("string") for c in (f"{x}s", f"{x}n", f"{x}j") if c in fields.columns]).isNull()
    none_p, none_g = none("p"), none("g")
    what = lambda kind: F.when(line, f"{kind}_line_item").otherwise(f"{kind}_field")
    wrong = F.when(F.col("leaf").isin(*MONEY), "wrong_money").when(F.col("leaf") == "qty", "wrong_qty").when(F.col("leaf") == "date", "wrong_date").otherwise("wrong_text")
    return fields.withColumn("category", F.when(F.col("same"), None).when(none_p, what("missing")).when(none_g, what("hallucinated")).otherwise(wrong))


def most_common(rows: DataFrame, column: str) -> DataFrame:
    """column, n, rank: values by falling count, then by value. The counts, not the rows, are ordered."""
    by = rows.groupBy(column).agg(F.count("*").alias("n"))
    return by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), column)).cast("long"))


def second_pass(records: DataFrame, second: DataFrame, order: str = "ord") -> DataFrame:
    """records (id, output, ...) with second: the output of the last of their rows in second (id, output, ord); null where
    there is none or it is null. Repeated rows are settled before the join, so records don't multiply."""
    last = second.groupBy("id").agg(F.max_by(F.struct("output"), order)["output"].alias("second"))
    return records.join(last, "id", "left")


def self_consistent(agreement: Column, threshold: float = 0.85) -> Column:
    """struct(ok, agreement) of two passes over one document; a null agreement (a pass is missing) is (false, 0)."""
    share = F.coalesce(agreement, F.lit(0.0))
    return F.struct((agreement.isNotNull() & (share >= threshold)).alias("ok"), share.alias("agreement"))


def consistency(first: DataFrame, second: DataFrame, threshold: float = 0.85) -> DataFrame:
    """id, agreement (rounded), kept, reason. first: id and its agreement with the second pass; second: id, null_second
    (of repeated ids, one that isn't null counts). Rows whose second pass is absent or null are kept, with null agreement."""
    met = first.join(second.groupBy("id").agg(F.bool_and("null_second").alias("null_second")), "id", "left")
    return _consistent(met, F.coalesce(~F.col("null_second"), F.lit(False)), threshold)


def consistency_of(records: DataFrame, second: DataFrame, threshold: float = 0.85, order: str = "ord") -> DataFrame:
    """consistency() of records (id, output struct) and the last of their second passes (id, output struct, ord)."""
    met = second_pass(records.select("id", "output"), second, order)
    scores = pair_scores(met.withColumn("seen", F.col("second").isNotNull()), "second", "output", ("seen",))
    return _consistent(scores, F.col("seen"), threshold)


def _consistent(met: DataFrame, seen: Column, threshold: float) -> DataFrame:
    kept = ~seen | (F.col("agreement") >= threshold)
    reason = F.when(~kept, F.format_string("consistency: %.3f", F.col("agreement")))
    return met.select("id", F.when(seen, F.round("agreement", 4)).alias("agreement"), kept.alias("kept"), reason.alias("reason"))


def sums_up(invoice: Column, tolerance: float = 0.02) -> Column:
    """struct(lines, total): whether the lines' totals make the subtotal, and subtotal and tax the grand total."""
    total = F.aggregate(F.coalesce(invoice["line_items"], F.array()), F.lit(0.0), lambda s, x: s + F.coalesce(x["total"], F.lit(0.0)))
    return F.struct((F.abs(total - invoice["subtotal"]) <= tolerance).alias("lines"), (F.abs(invoice["subtotal"] + invoice["tax"] - invoice["grand_total"]) <= tolerance).alias("total"))


def route(invoice: Column, most_lines: int = 20, tolerance: float = 0.02) -> Column:
    """Reasons (array) to ask the teacher about a student's invoice; empty where there is none: many_lines, arithmetic
    (lines and tax don't make the grand total), missing:field for each required top field that is null, and no_invoice."""
    x = invoice
    total = F.aggregate(F.coalesce(x["line_items"], F.array()), F.lit(0.0), lambda s, y: s + F.coalesce(y["total"], F.lit(0.0)))
    missing = [F.when(x[c].isNull(), f"missing:{c}") for c in _HEADS if c != "payment_terms"]
    wrong = F.abs(total + x["tax"] - x["grand_total"]) > tolerance
    found = F.array_compact(F.array(F.when(F.size(x["line_items"]) > most_lines, "many_lines"), F.when(wrong, "arithmetic"), *missing))
    return F.when(x.isNull(), F.array(F.lit("no_invoice"))).otherwise(found)
