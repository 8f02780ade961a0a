"""Reports of an evaluation: latencies, costs and quality in one row, and the table that sets quality against cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.normalise import model_size
from millrace.operators import cost
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.review import quality_bar


@dataclass(frozen=True)
class Machine:
    """Own hardware; throughput may be a figure or a column (measured requests a second)."""

    capex: float = 1100.0
    years: float = 3.0
    utilisation: float = 1.0
    watts: float = 360.0
    per_kwh: float = 0.15

    def hourly(self) -> float:
        return cost.amortised_hourly(self.capex, self.years, self.utilisation, self.watts, self.per_kwh)

    def energy(self, per_second: Column) -> Column:
        """Energy cost of one request."""
        return F.lit(self.watts / 1000 * self.per_kwh) / (per_second * 3600)

    def own_1k(self, per_second: Column) -> Column:
        low = F.raise_error(F.lit("throughput must be above 0"))
        return F.when(per_second > 0, F.lit(self.hourly()) / (per_second * 3600) * 1000).otherwise(low)

    def break_even(self, api: Column, per_second: Column) -> Column:
        return cost.break_even(self.capex * self.utilisation, self.years, api, self.energy(per_second))


def latencies(calls: DataFrame, column: str = "latency", by: tuple[str, ...] = ()) -> DataFrame:
    """p50, p95 (linear between neighbours) and requests a second of runs of calls one after the other: one row, or one for
    each value of the columns `by`. Exact whatever the number of calls: ranks are selected by counts."""
    ranked = exact_quantiles(calls, column, (0.5, 0.95), by).select(*by, F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))
    speed = calls.groupBy(*by).agg(F.avg(column).alias("mean")).select(*[F.col(c).alias(f"_{c}") for c in by], (1 / F.greatest("mean", F.lit(1e-9))).alias("per_second"))
    if not by:
        return speed.join(ranked, how="left").select("p50", "p95", "per_second")  # one row by one at most
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return speed.join(ranked, same, "left").select(*[F.col(f"_{c}").alias(c) for c in by], "p50", "p95", "per_second")


def evaluation(quality: DataFrame, speed: DataFrame, api: Column, machine: Machine, metric: str = "f1_macro", teacher: float | None = None, bar: float = 0.95) -> DataFrame:
    """One row: what quality has, the ratio to the teacher and whether it meets the bar, latencies and costs. quality and
    speed have one row each; api is the cost of one request to the teacher."""
    row = quality.crossJoin(F.broadcast(speed))  # one row by one
    q = quality_bar(F.col(metric), F.lit(teacher).cast("double"), bar)
    row = row.withColumn("teacher_metric", F.lit(1.0 if teacher is None else teacher)).withColumn("ratio", q["ratio"]).withColumn("meets_bar", q["meets_bar"])
    row = row.withColumn("api_1k", api * 1000).withColumn("own_1k", machine.own_1k(F.col("per_second")))
    low = F.raise_error(F.lit("own cost must be above 0"))
    row = row.withColumn("multiple", F.when(F.col("own_1k") > 0, F.col("api_1k") / F.col("own_1k")).otherwise(low))
    return row.withColumn("break_even", machine.break_even(api, F.col("per_second")))


def money_table(report: DataFrame, metric: str = "f1_macro", bar: float = 0.95) -> DataFrame:
    """ord, metric, teacher, student, win: the eight lines of the table of one report row; missing figures are n/a."""
    no = F.lit("n/a")
    has = lambda c: F.col(c) if c in report.columns else F.lit(None).cast("double")
    said = lambda form, x: F.when(x.isNotNull(), F.format_string(form, x)).otherwise(no)
    share = lambda x: said("%.1f%%", x * 100)
    verdict = F.concat(share(has("ratio")), F.lit(" of teacher — "), F.when(F.col("meets_bar"), "meets").otherwise("below"), F.lit(f" {bar:.0%} bar"))
    even = F.when(F.col("break_even").isNotNull(), F.format_string("~%,.0f req/day", "break_even")).otherwise("none")
    # The table's wording.
    lines = [
        ("$/1k requests", said("$%,.2f", has("api_1k")), said("$%,.4f", has("own_1k")), said("%,.0fx cheaper", has("multiple"))),
        (f"Quality ({metric})", F.concat(said("%.4f", has("teacher_metric")), F.lit(" (ref)")), said("%.4f", has(metric)), verdict),
        ("Teacher-agreement (fresh pool)", F.lit("—"), share(has("agreement")), F.lit("generalization")),
        ("Schema-valid rate", F.lit("—"), share(has("schema_valid_rate")), F.lit("robustness")),
        ("Exact match", F.lit("—"), share(has("exact_rate")), F.lit("strictest view")),
        ("p95 latency", F.lit("~2.1 s (typ. API)"), said("%,.0f ms", has("p95") * 1000), F.lit("lower")),
        ("Data egress", F.lit("leaves org"), F.lit("stays local"), F.lit("privacy")),
        ("Break-even volume", F.lit("—"), even, F.lit("above this, local wins")),
    ]
    rows = [F.struct(F.lit(i).cast("long").alias("ord"), F.lit(m).alias("metric"), t.alias("teacher"), s.alias("student"), w.alias("win")) for i, (m, t, s, w) in enumerate(lines)]
    return report.select(F.inline(F.array(*rows)))


def local_table(report: DataFrame, teacher: str, student: str, retries: int, metric: str = "f1_macro", bar: float = 0.95) -> DataFrame:
    """ord, axis, teacher, student, win: the seven lines of the table where the teacher runs on own hardware as well, so
    that it costs nothing by price. teacher and student are models' names, whose sizes are read off (model_size)."""
    sized = report.withColumn("_t", model_size(F.lit(teacher))).withColumn("_s", model_size(F.lit(student)))
    has = lambda c: F.col(c) if c in report.columns else F.lit(None).cast("double")
    said = lambda form, x: F.when(x.isNotNull(), F.format_string(form, x)).otherwise("n/a")
    size = lambda c: F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")
    share = lambda c: said("%.1f%%", has(c) * 100)
    billions = F.concat(size("_t"), F.lit("B"))
    # The table's wording.
    lines = [
        ("Model footprint", F.coalesce(F.concat(billions, F.lit("-class")), F.lit("open teacher")), F.concat(F.lit(student.split("/")[-1]), F.coalesce(F.concat(F.lit(" (~"), size("_s"), F.lit("B)")), F.lit(""))), F.coalesce(F.concat(F.format_string("~%.0f", F.col("_t") / F.col("_s")), F.lit("× smaller")), F.lit("smaller"))),
        (f"Quality ({metric})", F.concat(said("%.4f", has("teacher_metric")), F.lit(" (ref)")), F.concat(said("%.4f", has(metric)), F.lit(" ("), share("ratio"), F.lit(" of teacher)")), F.concat(F.when(F.col("meets_bar"), "meets").otherwise("below"), F.lit(f" {bar:.0%} bar"))),
        ("Schema-valid rate", F.lit("—"), F.concat(share("schema_valid_rate"), F.lit(f" (after ≤{retries} constrained-repair retries)")), F.lit("robustness")),
        ("Exact match", F.lit("—"), share("exact_rate"), F.lit("strictest view")),
        ("p95 latency", F.coalesce(F.concat(F.lit("full "), billions, F.lit(" forward")), F.lit("full teacher forward")), said("%,.0f ms", has("p95") * 1000), F.lit("smaller footprint")),
        ("Data egress", F.lit("stays local"), F.lit("stays local"), F.lit("on-prem / private")),
        ("$/1k (GPU amortized)", said("$%,.4f", has("api_1k")), said("$%,.4f", has("own_1k")), F.lit("both ~free locally")),
    ]
    rows = [F.struct(F.lit(i).cast("long").alias("ord"), F.lit(m).alias("axis"), t.alias("teacher"), s.alias("student"), w.alias("win")) for i, (m, t, s, w) in enumerate(lines)]
    return sized.select(F.inline(F.array(*rows)))


def failures(fields: DataFrame, worst: int = 5) -> DataFrame:
    """One row of a failure analysis over categorise() rows: n_docs, n_perfect, n_fields, n_errors, error_share,
    categories and leaves (arrays of name, n, share of errors; by falling count, then name), worst (the documents with
    most errors). One aggregation a document; counts of categories and leaves are summed before they meet."""
    wrong = F.col("category").isNotNull()
    by = fields.groupBy("id").agg(F.count("*").alias("f"), F.count_if(wrong).alias("e"))
    sums = by.agg(F.count("*").alias("n_docs"), F.count_if(F.col("e") == 0).alias("n_perfect"), F.sum("f").alias("n_fields"), F.sum("e").alias("n_errors"))
    top = by.where("e > 0").orderBy(F.desc("e"), "id").limit(worst).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("e")).alias("o"), "id", F.col("e").alias("n_errors"), F.col("f").alias("n_fields")))), lambda x: F.struct(x["id"].alias("id"), x["n_errors"].alias("n_errors"), x["n_fields"].alias("n_fields"))).alias("worst"))
    ranked = lambda c: fields.where(wrong).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "name", "n"))), lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias(c))
    row = sums.crossJoin(F.broadcast(ranked("category"))).crossJoin(F.broadcast(ranked("leaf"))).crossJoin(F.broadcast(top))  # one row each
    share = lambda xs: F.transform(xs, lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"), (x["n"] / F.greatest("n_errors", F.lit(1))).alias("share")))
    return row.select("n_docs", "n_perfect", "n_fields", "n_errors", (F.col("n_errors") / F.greatest("n_fields", F.lit(1))).alias("error_share"), share(F.col("category")).alias("categories"), share(F.col("leaf")).alias("leaves"), "worst")


def markdown(table: DataFrame, order: str = "ord") -> DataFrame:
    """One row, text: a table of few rows (a report) in markdown, in the order of a column that is left out."""
    names = [c for c in table.columns if c != order]
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", r"\\|")
    line = F.concat(F.lit("| "), F.array_join(F.array(*[clean(c) for c in names]), " | "), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"])
    head = F.array(F.lit("| " + " | ".join(names) + " |"), F.lit("|" + "---|" * len(names)))
    return table.agg(F.array_join(F.concat(head, lines), "\n").alias("text"))
