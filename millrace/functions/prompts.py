"""Prompts, chat turns, labels in free text, and keys of calls, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.normalise import label

# The user turn's frame and the turn that asks again after a refused reply.
FRAME = "<document>\n%s\n</document>\nOutput:"
AGAIN = "Your previous reply was not accepted: %s\nReturn ONLY a single JSON object that exactly matches the required schema — no prose, no markdown fences, no trailing text. All money fields must be plain numbers, the date must be ISO-8601 (YYYY-MM-DD), currency an ISO-4217 code, and every required key must be present."
#: What a call's key covers, in the order of the key's JSON.
CALL = ("max_tokens", "model", "provider", "salt", "system", "temperature", "user")


def user_prompt(text: Column) -> Column:
    before, after = FRAME.split("%s")
    return F.concat(F.lit(before), text, F.lit(after))


def repair_hint(error: Column) -> Column:
    before, after = AGAIN.split("%s")
    return F.concat(F.lit(before), F.coalesce(error, F.lit("invalid output")), F.lit(after))


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def training_messages(system: str, text: Column, output: Column) -> Column:
    """The chat that a student model is tuned on."""
    return F.array(turn("system", F.lit(system)), turn("user", user_prompt(text)), turn("assistant", output))


def retry_messages(system: str, text: Column, reply: Column, error: Column) -> Column:
    """The chat of a later attempt: the first one's, with the last refused reply alone."""
    return F.array(turn("system", F.lit(system)), turn("user", user_prompt(text)), turn("assistant", reply), turn("user", repair_hint(error)))


def hint(batch: Column, hints: list[str | None]) -> Column:
    """Steering hints dealt to batches in turn."""
    return F.element_at(F.array(*[F.lit(h).cast("string") for h in hints]), (F.pmod(batch, F.lit(len(hints))) + 1).cast("int"))


def call_key(**parameters: Column) -> Column:
    """The key of a memoised call: 40 hexadecimal digits over all of CALL; an absent parameter counts as null."""
    row = F.struct(*[parameters.get(c, F.lit(None)).cast("string").alias(c) for c in CALL])
    return F.substring(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256), 1, 40)


def label_in(reply: Column) -> Column:
    """The label that a rater's free text gives: the first line that begins with a known one (after bullets and
    "label:"), else by the words in it, else incorrect."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    word = lambda s: F.regexp_extract(F.replace(F.regexp_replace(F.trim(s), r"^[*\-# ]+", ""), F.lit("label:"), F.lit("")), r"^\s*(\S+)", 1)
    said = F.get(F.array_compact(F.transform(F.split(low, r"\r\n|[\r\n]"), lambda s: label(word(s)))), F.lit(0))
    return F.coalesce(said, F.when(low.contains("incorrect"), "incorrect").when(low.contains("correct"), "correct").otherwise("incorrect"))
