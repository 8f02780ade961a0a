"""Exact quantiles of groups of any size, by selecting ranks digit by digit.

A number's bits, read as an integer that keeps the order, are cut into digits. Counts by leading digit tell in which digit a
rank lies; only the rows with that digit are counted by the next one, and so on, until few rows are left, which are sorted,
or no digit is, when all that are left are equal. Counts are added up in the tasks first (at most 2 ** WIDTH a group and
rank), so no group is held or sorted in one place, and each round reads a fraction of the rows of the one before.

Defined cases: null values are left out, and a group of nothing else has no row; NaN is the greatest value, as Spark has it;
a null in a group column is a group of its own; an empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import keep

#: Bits of a digit, and rows that may be left to be sorted.
WIDTH, FEW = 12, 200_000


def ordered(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers; NaN is the greatest, both zeros are one."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).astype("<f8").view("<i8")
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def _met(a: DataFrame, b: DataFrame, on: list[str], more: Column | None = None) -> DataFrame:
    """a with the columns of b where these agree, nulls being equal; b's are dropped."""
    right = b.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in b.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on] + ([] if more is None else [more])
    cond = same[0]
    for x in same[1:]:
        cond = cond & x
    return a.join(right, cond).drop(*[f"_{c}" for c in on])


def exact_quantiles(rows: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = (), few: int = FEW) -> DataFrame:
    """by..., n, q: one row a group, q the quantiles in the order of `at`, linear between neighbours."""
    if any(not 0 <= p <= 1 for p in at):
        raise ValueError("quantiles lie between 0 and 1")
    groups = [f"g{i}" for i in range(len(by))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = ordered(batch.column(len(groups)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=[*groups, "v", "k"])

    plain = rows.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(by, groups, strict=True)], F.col(f"`{value}`").cast("double").alias("v")).where("v is not null")
    kinds = ", ".join([*(f"`{g}` {plain.schema[g].dataType.simpleString()}" for g in groups), "v double, k long"])
    left = keep(plain.mapInArrow(read, kinds).withColumn("prefix", F.lit(0).cast("long")), "quantiles")
    sizes = keep(left.groupBy(*groups).agg(F.count("*").alias("n")).where("n > 0"), "sizes")
    wanted = F.array(*[F.lit(float(p)) for p in at])
    asked = sizes.select(*groups, "n", F.posexplode(wanted).alias("i", "p")).withColumn("place", F.col("p") * (F.col("n") - 1))
    ranks = asked.select(*groups, F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    wanted = keep(ranks.select(*groups, "rank", F.col("rank").alias("within"), F.lit(0).cast("long").alias("prefix")), "ranks")
    path = [*groups, "prefix"]
    for shift in [*range(64 - WIDTH, 0, -WIDTH), 0]:
        if left.limit(few + 1).count() <= few:
            break
        counts = left.groupBy(*path, F.shiftright("k", shift).alias("digit")).agg(F.count("*").alias("rows"))
        before = F.sum("rows").over(Window.partitionBy(*path).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1))
        ranges = counts.withColumn("before", F.coalesce(before, F.lit(0)))
        inside = (F.col("within") >= F.col("before")) & (F.col("within") < F.col("before") + F.col("rows"))
        wanted = keep(_met(wanted, ranges, path, inside).select(*groups, "rank", (F.col("within") - F.col("before")).alias("within"), F.col("digit").alias("prefix")), "ranks")
        narrowed = left.withColumn("prefix", F.shiftright("k", shift))
        left = keep(_met(narrowed, wanted.select(*path).distinct(), path), "quantiles")
    else:  # no digit is left: the rows of a path are equal
        told = _met(wanted, left.groupBy(*path).agg(F.first("v").alias("v")), path)
        return _between(asked, told.select(*groups, "rank", "v"), by, groups)
    placed = left.withColumn("within", F.row_number().over(Window.partitionBy(*path).orderBy("k")).cast("long") - 1)
    told = _met(wanted, placed.select(*path, "within", "v"), [*path, "within"])
    return _between(asked, told.select(*groups, "rank", "v"), by, groups)


def _between(asked: DataFrame, told: DataFrame, by: Sequence[str], groups: list[str]) -> DataFrame:
    """The quantiles from the values at the ranks around them."""
    for name, rank in (("low", F.floor("place")), ("high", F.ceil("place"))):
        asked = _met(asked.withColumn("rank", rank), told.withColumnRenamed("v", name), [*groups, "rank"]).drop("rank")
    share = F.col("place") - F.floor("place")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + share * (F.col("high") - F.col("low")))
    rows = asked.groupBy(*groups, "n").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("q"))  # one a quantile
    return rows.select(*[F.col(g).alias(c) for g, c in zip(groups, by, strict=True)], "n", F.col("q.v").alias("q"))
