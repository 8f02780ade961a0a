"""JSON taken out of a model's reply, and the contract that an invoice has to meet.

A reply is searched for JSON in three steps: all of it, its first fenced block, then the first object, else the first
array, that starts anywhere (in the block, if there is one). Only replies that the first two steps leave open reach
Python. The contract is checked on VARIANT values by built-in expressions; each breach has a code (missing:date,
type:vendor, value:tax, extra:note, empty:line_items, and line_items[2].qty in a line), and a row's reason lists all.

Where this differs from a lenient JSON reader: NaN, Infinity and repeated keys make a text invalid, and halves of a cent
are rounded to the even one on the decimal value."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions import normalise
from millrace.functions.normalise import let

# Fixed values of the contract, in the order of the canonical form.
FIELDS = ("vendor", "date", "currency", "line_items", "subtotal", "tax", "grand_total", "payment_terms")
LINE_FIELDS = ("description", "qty", "unit_price", "total")
OPTIONAL = ("payment_terms",)
TEXTS = ("vendor", "date", "currency", "payment_terms", "description")
# What a block of a reply stands between, and the name it may have.
FENCE, NAMED = "```", "json"

#: What follows a text that is read as JSON, to tell where it ends.
MARK = "end of text \u241f"
_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL", "INT", "SMALLINT", "TINYINT")


#: What JSON looks like at its start; a parser that has to throw for other texts takes several times as long.
_MAY_BE_JSON = r'^(?:[{\["0-9-]|(?:true|false|null)$)'
#: What a text begins with that is JSON as it stands, or has to be searched.
FOUND, OPEN = "=", "?"


@F.pandas_udf(StringType())
def _embedded(texts: pd.Series) -> pd.Series:
    """A text that was FOUND as it stands; of an OPEN one the first object, else its first array: the earliest start from
    which one can be read whole."""
    reader = json.JSONDecoder()

    def search(told: str | None) -> str | None:
        text = told[1:] if told else None
        if told and told[0] == FOUND:
            return text
        for opening in "{[" if text else "":
            at = text.find(opening)
            while at >= 0:
                try:
                    return text[at : reader.raw_decode(text, at)[1]]
                except (ValueError, RecursionError):
                    at = text.find(opening, at + 1)
        return None

    return texts.map(search)


def parsed(text: Column) -> Column:
    """The text's value as VARIANT, null where it is not JSON as it stands. The built-in parser ignores what comes after
    a value, so a text is read once as the first of two array elements: the second has to be the mark that follows it. Only
    a text that holds the mark itself is read twice, within an array and within an object, which just one value allows."""
    marked = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{MARK}"]')))
    once = let(marked, lambda v: F.when(F.try_variant_get(v, "$[1]", "string") == MARK, F.try_variant_get(v, "$[0]", "variant")))
    within = F.struct(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).alias("a"), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).alias("o"))
    twice = let(within, lambda x: F.when(x["o"].isNotNull(), F.try_variant_get(x["a"], "$[0]", "variant")))
    return F.when(F.contains(text, F.lit(MARK)), twice).otherwise(once)


def is_json(text: Column) -> Column:
    """Whether the text as it stands is JSON; false for null."""
    return parsed(text).isNotNull()


def _stands(text: Column) -> Column:
    """is_json() of a text without white space at its ends."""
    return F.coalesce(text.rlike(_MAY_BE_JSON), F.lit(False)) & is_json(text)


def _fenced(text: Column) -> Column:
    """What the first fenced block holds, without its name and white space around; null where no block is closed."""

    def bare(block: Column) -> Column:
        return normalise.strip(F.when(block.startswith(NAMED), F.substring(block, len(NAMED) + 1, 1 << 30)).otherwise(block))

    parts = let(F.split(text, FENCE, 3), lambda p: F.when(F.size(p) == 3, F.get(p, F.lit(1))))
    return F.when(F.contains(text, F.lit(FENCE)), let(parts, bare))


def first_json(reply: Column) -> Column:
    """The first JSON value in a reply, as text; null where there is none, or the reply is null or blank. What is taken goes
    through the search as it is, so that no form of the reply is parsed for it again."""
    whole = normalise.strip(reply)
    fenced = _fenced(whole)
    found, open_ = (lambda t, mark=mark: F.concat(F.lit(mark), t) for mark in (FOUND, OPEN))
    return _embedded(F.when(_stands(whole), found(whole)).when(_stands(fenced), found(fenced)).otherwise(open_(F.coalesce(fenced, whole))))


def batch_texts(reply: Column, least: int = 40) -> Column:
    """The texts of a generated batch: its reply has to be a JSON array; entries that are strings of `least` characters
    without the white space at their ends are kept, stripped, in order. Null where the reply has no array."""
    items = F.try_variant_get(parsed(first_json(reply)), "$", "array<variant>")
    return F.filter(F.transform(items, lambda v: normalise.strip(_text(v))), lambda t: normalise.long_enough(t, least))


def _kind(v: Column) -> Column:
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def _text(v: Column, kind: Column | None = None) -> Column:
    return F.when((_kind(v) if kind is None else kind) == "STRING", F.try_variant_get(v, "$", "string"))


def _places(name: str) -> int:
    return 4 if name == "qty" else 2


def _of_text(name: str, text: Column) -> Column:
    """The normalised value of a field that is given as text."""
    if name in ("vendor", "description"):
        return let(normalise.collapse(text), lambda x: F.when(x != "", x))
    read = {"date": normalise.date_iso, "currency": normalise.currency, "payment_terms": normalise.payment_terms, "qty": normalise.quantity}
    return let(text, read.get(name, normalise.money))


def _value(name: str, v: Column, kind: Column) -> Column:
    """A text as its field reads it, an amount also as a number, rounded; null for anything else, truth values included."""
    text = F.when(kind == "STRING", _of_text(name, F.try_variant_get(v, "$", "string")))
    if name in TEXTS:
        return text
    return F.when(kind.isin(*_NUMBERS), F.bround(F.try_variant_get(v, "$", "double"), _places(name))).otherwise(text)


def _field(name: str, v: Column, path: Column) -> Column:
    """struct(value, code): a field's normalised value, and what is wrong with it, else null."""
    code = lambda kind: F.concat(F.lit(f"{kind}:"), path)

    def of_kind(x: Column) -> Column:
        v, kind = x["v"], x["kind"]

        def of_value(value: Column) -> Column:
            if name in OPTIONAL:
                wrong = F.when(v.isNotNull() & ~kind.isin("STRING", "VOID"), code("type"))
            else:
                fits = (kind == "STRING") if name in TEXTS else kind.isin("STRING", *_NUMBERS)
                wrong = F.when(v.isNull(), code("missing")).when(~fits, code("type")).when(value.isNull(), code("value"))
            return F.struct(value.alias("value"), wrong.alias("code"))

        return let(_value(name, v, kind), of_value)

    return let(let(v, lambda v: F.struct(v.alias("v"), _kind(v).alias("kind"))), of_kind)


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _extra(fields: Column, known: tuple[str, ...], path) -> Column:
    return F.transform(F.array_sort(F.array_except(F.map_keys(fields), F.array(*map(F.lit, known)))), lambda k: F.concat(F.lit("extra:"), path(k)))


def _fields(m: Column, names: tuple[str, ...], path) -> Column:
    return F.struct(*[_field(n, F.try_element_at(m, F.lit(n)), path(F.lit(n))).alias(n) for n in names])


def _line(x: Column, i: Column) -> Column:
    at = lambda name: F.concat(F.lit("line_items["), i.cast("string"), F.lit("]."), name)

    def of_object(m: Column) -> Column:
        def end(s: Column) -> Column:
            codes = F.concat(F.array(*[s[n]["code"] for n in LINE_FIELDS]), _extra(m, LINE_FIELDS, at))
            return F.struct(F.struct(*[s[n]["value"].alias(n) for n in LINE_FIELDS]).alias("item"), F.when(m.isNotNull(), F.array_compact(codes)).otherwise(F.array(F.concat(F.lit("type:line_items["), i.cast("string"), F.lit("]")))).alias("errors"))

        return let(_fields(m, LINE_FIELDS, at), end)

    return let(_object(x), of_object)


def _kinds(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} {'string' if n in TEXTS else f'array<struct<{_of_line}>>' if n == 'line_items' else 'double'}" for n in names)


_of_line = ", ".join(f"{n}: {'string' if n in TEXTS else 'double'}" for n in LINE_FIELDS)
#: The contract's kinds as a schema.
TYPED = _kinds(FIELDS)


#: What a list's kind is where its lines have the contract's keys and kinds, and nothing else.
_NUMBER_KIND = "(" + "|".join(_NUMBERS) + r")(\([0-9,]+\))?"
_LINES_KIND = "^ARRAY<OBJECT<" + ", ".join(f"{n}: {'STRING' if n in TEXTS else _NUMBER_KIND}" for n in sorted(LINE_FIELDS)) + ">>$"


def _lacks(x: Column, names) -> Column:
    return F.greatest(*[x[n].isNull() for n in names])


def _typed_lines(listed: Column) -> Column:
    """A VARIANT list as typed lines, where all of them have all fields, of the right kinds; else null. Its kind is told
    once for all lines. It leaves out a key that is missing or null in some of them, which comes out as null."""
    typed = F.when(F.schema_of_variant(listed).rlike(_LINES_KIND), F.try_variant_get(listed, "$", f"array<struct<{_of_line}>>"))
    return let(typed, lambda t: F.when(~F.exists(t, lambda y: y.isNull() | _lacks(y, LINE_FIELDS)), t))


def _typed_line(y: Column) -> Column:
    """The normalised fields of a typed line."""
    return F.struct(*[(_of_text(n, y[n]) if n in TEXTS else F.bround(y[n], _places(n))).alias(n) for n in LINE_FIELDS])


def _void_description(item: Column, i: Column) -> Column:
    """What alone can be wrong with a typed line."""
    return F.when(item["description"].isNull(), F.concat(F.lit("value:line_items["), i.cast("string"), F.lit("].description")))


def _items(listed: Column) -> Column:
    """struct(item, errors) of each line of a VARIANT list, null where it is none: typed lines at once, others by their values."""
    whole = lambda y, i: let(_typed_line(y), lambda x: F.struct(x.alias("item"), F.array_compact(F.array(_void_description(x, i))).alias("errors")))
    return let(_typed_lines(listed), lambda t: F.when(t.isNotNull(), F.transform(t, whole)).otherwise(F.transform(F.try_variant_get(listed, "$", "array<variant>"), _line)))


def _invoice(m: Column) -> Column:
    """struct(invoice, errors) of an object as a map."""
    heads = tuple(n for n in FIELDS if n != "line_items")

    def end(x: Column) -> Column:
        s, lines, listed = x["fields"], x["lines"], x["listed"]
        value = {n: s[n]["value"] for n in heads} | {"line_items": F.transform(lines, lambda y: y["item"])}
        of_list = F.when(listed.isNull(), "missing:line_items").when(lines.isNull(), "type:line_items").when(F.size(lines) == 0, "empty:line_items")
        within = F.coalesce(F.flatten(F.transform(lines, lambda y: y["errors"])), F.array().cast("array<string>"))
        every = F.array_compact(F.concat(F.array(*[s[n]["code"] for n in heads], of_list), _extra(m, FIELDS, lambda k: k), within))
        return let(every, lambda e: F.struct(F.when(F.size(e) == 0, F.struct(*[value[n].alias(n) for n in FIELDS])).alias("invoice"), e.alias("errors")))

    return let(F.try_element_at(m, F.lit("line_items")), lambda listed: let(F.struct(_fields(m, heads, lambda n: n).alias("fields"), listed.alias("listed"), _items(listed).alias("lines")), end))


def plain(text: Column) -> Column:
    """struct(v, whole) of a text that is what to_json() makes of an invoice: v is that typed struct, and whole tells that
    a null in it is written as one (else it stands for a key that is missing). So each field has its kind and its place, and
    there is nothing else. Null for any other text, which has to be taken apart by its values."""

    def of(v: Column) -> Column:
        short, whole = (F.to_json(v, {"ignoreNullFields": x}) == text for x in ("true", "false"))
        return F.when(whole, F.struct(v.alias("v"), F.lit(True).alias("whole"))).when(short, F.struct(v.alias("v"), F.lit(False).alias("whole")))

    number = ~F.contains(text, F.lit('NaN"')) & ~F.contains(text, F.lit('Infinity"'))  # texts that a reader takes for numbers
    return F.when(text.startswith("{") & number, let(F.from_json(text, TYPED), of))


def _complete(v: Column) -> Column:
    """Whether a typed struct has all fields that the contract wants."""
    heads = [n for n in FIELDS if n not in OPTIONAL]
    return v.isNotNull() & ~_lacks(v, heads) & ~F.exists(v["line_items"], lambda y: y.isNull() | _lacks(y, LINE_FIELDS))


def _typed_invoice(v: Column) -> Column:
    """_invoice() of a complete typed struct: only values can be wrong, and the list empty."""
    read = lambda x, n: _of_text(n, x[n]) if n in TEXTS else F.bround(x[n], _places(n))
    items = F.transform(v["line_items"], _typed_line)

    def end(x: Column) -> Column:
        codes = [F.when(x[n].isNull(), f"value:{n}") for n in FIELDS if n not in ("line_items", *OPTIONAL)]
        within = F.transform(x["line_items"], _void_description)
        every = F.array_compact(F.concat(F.array(*codes, F.when(F.size(x["line_items"]) == 0, "empty:line_items")), within))
        return let(every, lambda e: F.struct(F.when(F.size(e) == 0, x).alias("invoice"), e.alias("errors")))

    return let(F.struct(*[(items if n == "line_items" else read(v, n)).alias(n) for n in FIELDS]), end)


def validate(output: Column) -> Column:
    """struct(invoice, errors) of a JSON text: invoice is the normalised struct, null unless errors is empty. An array
    in place of an object, broken JSON and null have one error each. A text that is plain() and complete is read by its
    schema; any other is parsed once, and its values are looked at one by one."""
    one = lambda code: F.struct(F.lit(None).alias("invoice"), F.array(F.lit(code)).alias("errors"))

    def of_value(v: Column) -> Column:
        return F.when(v.isNull(), one("not_json")).otherwise(let(_object(v), lambda m: F.when(m.isNull(), one("not_object")).otherwise(_invoice(m))))

    return let(plain(output)["v"], lambda v: F.when(_complete(v), _typed_invoice(v)).otherwise(let(parsed(output), of_value)))


def canonical_json(invoice: Column) -> Column:
    """Keys in the contract's order, payment_terms always there."""
    return F.when(invoice.isNotNull(), F.to_json(invoice, {"ignoreNullFields": "false"}))


def schema_gate(records: DataFrame, output: str = "output") -> DataFrame:
    """records with output in canonical form where it passes, invoice, and _drop_reason (null: kept). Nothing shuffles;
    the caller filters on _drop_reason, once for each side. A column `valid` from labelling is not consulted."""
    out = records.withColumn("_checked", validate(F.col(output)))
    reason = F.when(F.size("_checked.errors") > 0, F.concat(F.lit("schema: "), F.array_join("_checked.errors", ", ")))
    passed = F.coalesce(canonical_json(F.col("_checked.invoice")), F.col(output))
    return out.withColumn(output, passed).withColumn("invoice", F.col("_checked.invoice")).withColumn("_drop_reason", reason).drop("_checked")


def public(records: DataFrame) -> DataFrame:
    """Without columns that are for the engine only (a leading underscore)."""
    return records.select(*[F.col(f"`{c}`") for c in records.columns if not c.startswith("_")])


def json_schema() -> dict:
    """The contract as JSON Schema."""
    text, number = {"type": "string", "minLength": 1}, {"type": "number"}
    line = {"type": "object", "additionalProperties": False, "required": list(LINE_FIELDS), "properties": {n: text if n == "description" else number for n in LINE_FIELDS}}
    kinds = {"vendor": text, "date": {"type": "string", "format": "date"}, "currency": {"type": "string", "pattern": "^[A-Z]{3}$"}, "line_items": {"type": "array", "minItems": 1, "items": line}, "payment_terms": {"type": ["string", "null"]}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Invoice", "type": "object", "additionalProperties": False, "required": [n for n in FIELDS if n not in OPTIONAL], "properties": {n: kinds.get(n, number) for n in FIELDS}}
