"""Cost analytics as column expressions, and usage roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def api_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Of one request; prices are per million tokens. Negative values are an error."""
    low = F.least(tokens_in.cast("double"), tokens_out.cast("double"), price_in, price_out)
    return F.when(low < 0, F.raise_error(F.lit("negative tokens or prices"))).otherwise(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out)


def amortised_hourly(capex: float, years: float, utilisation: float, watts: float, per_kwh: float) -> float:
    if min(capex, watts, per_kwh) < 0 or years <= 0 or not 0 < utilisation <= 1:
        raise ValueError("cost parameters out of range")
    return capex / (years * 365 * 24) * utilisation + watts / 1000 * per_kwh


def break_even(capex: float, years: float, api: Column, energy: Column) -> Column:
    """Requests a day at which the capital's daily share is earned; null where a request saves nothing."""
    gap = api - energy
    return F.when(gap > 0, F.lit(capex / (years * 365)) / gap)


#: Rows that a price table may have, so that it can be broadcast.
MOST_PRICES = 10_000
MODES = ("either", "prefix", "exact")


def prices(calls: DataFrame, table: DataFrame, mode: str = "either", default: tuple[float, float] | None = None) -> DataFrame:
    """calls (model, ...) with the price row of an equal name or, in the modes with prefixes, of the first prefix in the
    table's order (ord). Modes: either (a name may begin with a row's prefix or the other way round), prefix (a name
    begins with a row's prefix), exact. Without a match prices are the default: 0 in mode either and 3 and 15 in mode
    exact unless given; mode prefix without a default raises. A null model has no match. A table of more than MOST_PRICES
    rows is an error, as it is broadcast to the distinct names."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {MODES}")
    if table.limit(MOST_PRICES + 1).count() > MOST_PRICES:
        raise ValueError(f"a price table has at most {MOST_PRICES} rows")
    names = calls.select("model").distinct()
    same = F.col("model") == F.col("prefix")
    begins, within = F.col("model").startswith(F.col("prefix")), F.col("prefix").startswith(F.col("model"))
    met = names.join(F.broadcast(table), {"either": begins | within, "prefix": begins, "exact": same}[mode], "left")
    first = met.groupBy("model").agg(F.min_by(F.struct("price_in", "price_out"), F.when(same, F.lit(None).cast("long")).otherwise(F.col("ord"))).alias("p"), F.min_by(F.struct("price_in", "price_out"), F.when(same, F.col("ord"))).alias("own"))
    first = first.select(F.col("model").alias("_name"), F.coalesce("own", "p").alias("_p"))
    rest = default or {"either": (0.0, 0.0), "exact": (3.0, 15.0)}.get(mode)
    missing = lambda i: F.lit(float(rest[i])) if rest else F.raise_error(F.concat(F.lit("no price for model "), F.coalesce("model", F.lit("null")))).cast("double")
    out = calls.join(first, F.col("model") == F.col("_name"), "left")
    return out.select(calls["*"], *[F.coalesce(f"_p.{c}", missing(i)).alias(c) for i, c in enumerate(("price_in", "price_out"))])


def volume_axis(top: float, steps: int = 60) -> range:
    """Volumes from 0 to top (10 at least) and one step beyond, in whole steps."""
    top = max(int(top), 10)
    step = max(top // steps, 1)
    return range(0, top + step, step)


def daily_curves(spark: SparkSession, volumes: range, api: Column, capex: float, years: float, utilisation: float, energy: Column) -> DataFrame:
    """volume, api_usd, own_usd: daily costs; own hardware costs its share of capital a day, and energy by request."""
    fixed = 24 * amortised_hourly(capex, years, utilisation, 0, 0)
    v = F.col("id")
    return spark.range(volumes.start, volumes.stop, volumes.step).select(v.alias("volume"), (v * api).alias("api_usd"), (F.lit(fixed) + v * energy).alias("own_usd"))


def usage(calls: DataFrame) -> DataFrame:
    """Per model: billed calls, cache hits, tokens, tokens per billed call, cost. Cache hits cost nothing."""
    billed = ~F.col("cached")
    cost = F.when(billed, api_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"))).otherwise(0.0)
    out = calls.groupBy("model").agg(F.count_if(billed).alias("calls"), F.count_if(F.col("cached")).alias("hits"), F.sum(F.when(billed, F.col("tokens_in")).otherwise(0)).alias("tokens_in"), F.sum(F.when(billed, F.col("tokens_out")).otherwise(0)).alias("tokens_out"), F.sum(cost).alias("usd"))
    return out.withColumn("tokens_per_call", (F.col("tokens_in") + F.col("tokens_out")) / F.greatest("calls", F.lit(1)))
