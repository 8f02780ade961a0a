"""Mixing sources to target weights along a time-varying curriculum.

Each source's schedule is a weight that changes linearly over training time t in [0, 1]; its integral gives the words
demanded up to t. A source's documents stand in a fixed pseudo-random order, over and over, and inverting the cumulated
demand at the word where a document begins gives its training position. Documents are range-sorted by position.

Running sums are taken in two steps, over 1024 cells of a source and within a cell, so that no task holds a whole source.
Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share `share` times all sizes; a target
stops at `most` times its source's size, and the excess goes to the others by weight until none is above.

Defined cases: null text has size 0 and takes nothing; a source of size 0 has target 0; the order is by a hash of the
id, then the id, then a hash of the text, so rows that repeat take a whole number of words each and reruns agree;
a document at the target's edge is taken in part (its first words); a null doc_id is a key like others; very long
texts are only counted (the stage cuts one at most a source); an empty table gives no rows; extra columns are left alone
by the query and kept by the stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import documents, keep, partitions

#: Fixed values of the contract: the weights that repeat over the sources.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """sizes: one row per source (source, source_size). Adds weight, target and place (0, 1, ... in code point order).

    Water-filling in closed form: in the order of size / weight, the sources up to some point are full. The level that
    the others would get rises with each source that is full and falls after that, so its maximum is the one."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    by_level = Window.orderBy("fill", "place")
    placed = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double")
    filled = placed.withColumn("weight", weight).withColumn("fill", most * F.col("source_size") / F.col("weight"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    marked = filled.withColumn("level", level).withColumn("top", F.max("level").over(every))
    return marked.select("source", "source_size", "weight", "place", F.least(most * F.col("source_size"), F.col("top") * F.col("weight")).alias("target"))


def curriculum(docs: DataFrame, share: float = 1.5, most: float = 2.0, slopes: tuple[float, ...] = (0.6, -0.6, 0.0)) -> DataFrame:
    """docs: any key columns, source, size long, and order_key long (60 bits), order_id long, order_text long, which order
    a source's rows. Adds source_size, target, taken, and turns: an array of (words, position) for each time it is taken.

    slopes: by source in turn, how a schedule's weight changes: from 1 - slope at the start to 1 + slope at the end."""
    spark = docs.sparkSession
    cell = F.shiftright(F.col("order_key"), 60 - 10).cast("int")
    rows = docs.withColumn("cell", cell)
    sums = keep(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "cells")
    goal = targets(sums.groupBy("source").agg(F.sum("cell_size").alias("source_size")), share, most)
    in_source = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    started = sums.withColumn("start", F.coalesce(F.sum("cell_size").over(in_source), F.lit(0)))
    goal = goal.withColumnRenamed("source", "goal_source")
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("place") % len(slopes) + 1).cast("int"))
    table = started.join(goal, started.source.eqNullSafe(goal.goal_source)).select(F.col("source").alias("cell_source"), F.col("cell").alias("cell_no"), "start", "source_size", "target", slope.alias("slope"))
    in_cell = Window.partitionBy("source", "cell").orderBy("order_key", "order_id", "order_text").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("inside", F.coalesce(F.sum("size").over(in_cell), F.lit(0)))
    met = run.join(table, run.source.eqNullSafe(table.cell_source) & (run.cell == table.cell_no))
    goal_words = F.round("target").cast("long")

    def turn(k: int) -> Column:
        begin = F.col("start") + F.col("inside") + k * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal_words - begin))
        # G(t) = t + slope (t^2 - t) is the share demanded by t; its inverse at u, written without cancellation
        u = F.try_divide(begin, goal_words)
        a = 1 - F.col("slope")
        position = F.try_divide(2 * u, a + F.sqrt(a * a + 4 * F.col("slope") * u))
        return F.when(words > 0, F.struct(words.alias("words"), position.alias("position")))

    turns = F.filter(F.array(*[turn(k) for k in range(int(-(-most // 1)))]), lambda x: x.isNotNull())
    out = met.withColumn("turns", turns).withColumn("taken", F.aggregate("turns", F.lit(0).cast("long"), lambda s, x: s + x.words))
    return out.drop("cell", "inside", "start", "slope", "cell_source", "cell_no")


def keyed(docs: DataFrame) -> list[Column]:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return [size.alias("size"), F.conv(F.substring(F.md5(F.concat(F.lit("order "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long").alias("order_key"), F.col("doc_id").cast("long").alias("order_id"), F.xxhash64("text").alias("order_text")]


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", *keyed(documents(spark, sf_dir)))
    out = curriculum(keep(docs, "sizes"))
    first = F.round(F.get("turns", F.lit(0))["position"], 9).alias("position")
    done = out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", first, F.size("turns").alias("turns"))
    return done.repartitionByRange(partitions(spark), F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row for each time a document is taken, range-sorted by training position; where a source's
    target cuts a document, the row has its first words (as far as the cut). Returns docs' own columns."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("source"), *keyed(docs))
    light = keep(plain.select("source", "size", "order_key", "order_id", "order_text"), "sizes")
    # rows that agree in all of these take the same number of words in turn; they are numbered to meet one by one
    agreed = ["source", "size", "order_key", "order_id", "order_text"]
    number = F.row_number().over(Window.partitionBy(*agreed).orderBy("order_key"))
    mixed = curriculum(light).where("taken > 0").withColumn("number", number).select(*[F.col(c).alias(f"m_{c}") for c in agreed], "number", "turns")
    numbered = plain.withColumn("number", number) if _repeats(light, agreed) else plain.withColumn("number", F.lit(1))
    same = numbered.number == mixed.number
    for c in agreed:
        same = same & numbered[c].eqNullSafe(mixed[f"m_{c}"])
    each = numbered.join(mixed, same).withColumn("turn", F.explode("turns"))
    first_words = F.slice(F.regexp_extract_all(F.col("text_of"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("turn.words").cast("int"))
    cut = F.when(F.col("turn.words") < F.col("size"), F.array_join(first_words, ""))
    at = {c: i for i, c in enumerate(names)}
    each = each.withColumn("text_of", F.col(f"c{at['text']}"))
    text = F.coalesce(cut, F.col("text_of"))
    kept = {"n_chars": F.length(text), "text": text}
    out = [kept.get(c, F.col(f"c{i}")).cast(docs.schema[i].dataType).alias(f"o{i}") for i, c in enumerate(names)]
    done = each.select(*out, F.col("turn.position").alias("position"), "order_id")
    return done.repartitionByRange(partitions(spark), "position", "order_id").sortWithinPartitions("position", "order_id").select(*[F.col(f"o{i}").alias(c) for i, c in enumerate(names)])


def _repeats(light: DataFrame, agreed: list[str]) -> bool:
    """Whether any rows agree in all of `agreed`: then a join on these needs numbers."""
    return bool(light.groupBy(*agreed).count().where("count > 1").limit(1).count())
