"""JSON lines, text folders, rating sheets, reports and settings. Paths may be of any file system that Spark reads."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.normalise import content_id, label, strip
from millrace.operators.gate import is_json
from millrace.sources.scratch import keep

# Columns of a rating sheet and of the sheet for settling disagreements.
SHEET = ("id", "source_document", "model_extraction", "label", "notes")
QUEUE = ("id", "rater_a", "rater_b", "adjudicated")
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped. A line that is not JSON, or doesn't fit the schema, is an error that
    names its file and its beginning (bad_lines tells its number)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    broken = F.raise_error(F.concat(F.lit("not a JSON line in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80)))
    parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    row = lines.select(parsed.alias("row"), "file", "value")
    checked = row.select(F.when(F.col("row._broken").isNotNull() | F.col("row").isNull(), broken).otherwise(F.col("row")).alias("row"))
    return checked.select("row.*").drop("_broken")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of every line of text files, blank ones too. A file is read in splits, however large it
    is: each split counts its lines, the counts of the splits before it in its file are added up (one row a split), and a
    line's number is that sum and its place in its split."""
    told = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = told.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    base = splits.withColumn("before", F.coalesce(before, F.lit(0))).drop("lines")
    return told.join(base, ["file", "start"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of lines that are not JSON; no file is read whole."""
    lines = numbered_lines(spark, path)
    return lines.where((F.trim(F.regexp_replace("value", r"\s", " ")) != "") & ~is_json(F.col("value")))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines, null fields kept. Never a path that rows are read from."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """file, text of the folder's *.txt: stripped; broken UTF-8 replaced; empty ones left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    text = strip(F.make_valid_utf8(F.col("content").cast("string")))
    return raw.select(F.substring_index("path", "/", -1).alias("file"), text.alias("text")).where("text <> ''")


def read_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """id, text, source of the folder's *.txt; of equal texts the first by file name counts."""
    rows = read_texts(spark, folder).withColumn("id", content_id(F.col("text")))
    return rows.groupBy("id").agg(F.min_by("text", "file").alias("text"), F.concat(F.lit("raw:"), F.min("file")).alias("source"))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """id, label (normalised, null where unknown), notes, raw_label of a filled sheet; rows without an id are skipped.
    A sheet without a column id is an error."""
    rows = spark.read.csv(path, **_CSV)
    if "id" not in rows.columns:
        raise ValueError(f"{path}: no column id")
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) if c in rows.columns else F.lit("")
    return rows.select(text("id").alias("id"), label(text("label")).alias("label"), text("notes").alias("notes"), text("label").alias("raw_label")).where("id <> ''")


def read_settled(spark: SparkSession, path: str) -> DataFrame:
    """id, label of settled disagreements; rows without a usable label are left out, the last of an id counts."""
    rows = read_ratings(spark, path).where("label is not null").withColumn("at", F.monotonically_increasing_id())
    return rows.groupBy("id").agg(F.max_by("label", "at").alias("label"))


def write_sheet(rows: DataFrame, path: str, columns: tuple[str, ...] = SHEET) -> None:
    """CSV with these columns; absent ones and nulls are empty."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns]
    rows.select(*cells).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", encoding="UTF-8")


def write_queue(disagreements: DataFrame, path: str) -> None:
    """The sheet on which disagreements (id, a, b) are settled."""
    write_sheet(disagreements.withColumnsRenamed({"a": "rater_a", "b": "rater_b"}), path, QUEUE)


def write_report(report: DataFrame, path: str) -> None:
    """A report (few rows, aggregates) as one JSON file in a folder."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def merged(base: dict, changes: dict) -> dict:
    """base with changes, maps merged at every depth."""
    both = {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in changes.items()}
    return base | both


def read_settings(path: str | Path, changes: dict | None = None) -> dict:
    """Settings of a JSON file, or of a YAML file where a YAML reader is installed. _root is the project's folder, from
    which relative paths count, and _path the file."""
    path = Path(path).resolve()
    text = path.read_text("utf-8")
    if path.suffix in (".yaml", ".yml"):
        import yaml  # not needed for anything else

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    try:
        root = project_root(path.parent)
    except FileNotFoundError:
        root = path.parent
    return merged(found or {}, changes or {}) | {"_root": str(root), "_path": str(path)}


def resolve_path(settings: dict, key: str) -> Path:
    """The path that settings has under paths.key; a relative one counts from the project's folder."""
    return Path(settings["_root"]) / settings["paths"][key]


def rewrite(rows: DataFrame, path: str) -> None:
    """JSON lines in place of what path held, rows made from path included: they are written next to it first, and take
    its place by renaming. A failed write leaves path as it was."""
    spark = rows.sparkSession
    fresh, old = f"{path.rstrip('/')}.next", f"{path.rstrip('/')}.last"
    write_jsonl(rows, fresh)
    names = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, old)]
    system = names[0].getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(names[2], True)
    if system.exists(names[0]) and not system.rename(names[0], names[2]):
        raise OSError(f"{path} can't be moved")
    if not system.rename(names[1], names[0]):
        raise OSError(f"{fresh} can't be moved to {path}")
    system.delete(names[2], True)


def upsert(updates: DataFrame, path: str, by: str, key: str = "id") -> None:
    """Sets the columns of updates (key and columns, one row a key; repeated keys are an error) in the rows of the Parquet
    table at path that have the key; columns that the table lacks are added to it. Of the table, which is partitioned by
    `by`, only the partitions that hold such a row are written again; the files of the others stay as they are. Keys that
    the table doesn't have change nothing. A run that was stopped can be repeated."""
    spark = updates.sparkSession
    base = spark.read.option("mergeSchema", True).parquet(path)
    new = [c for c in updates.columns if c != key]
    once = updates.groupBy(key).agg(F.count("*").alias("_times"), *[F.first(c).alias(f"_{c}") for c in new])
    told = F.raise_error(F.concat(F.lit("more than one update of "), F.col(key).cast("string"))).cast("boolean")
    once = keep(once.where(F.when(F.col("_times") > 1, told).otherwise(True)).withColumn("_hit", F.lit(True)), "updates")
    touched = base.join(once, key, "left_semi").select(by).distinct()
    rows = base.join(touched.select(F.col(by).alias("_by")), F.col(by).eqNullSafe(F.col("_by")), "left_semi").join(once, key, "left")
    value = lambda c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c) if c in base.columns else F.lit(None)).alias(c)
    columns = [value(c) if c in new else F.col(c) for c in base.columns if c != by] + [value(c) for c in new if c not in base.columns]
    merged_rows = keep(rows.select(*columns, by), "merged")  # read and written path are the same: it is whole before it is moved
    merged_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def project_root(start: str | Path, mark: str = "pyproject.toml") -> Path:
    """The nearest folder, from start upwards, that holds the mark."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / mark).exists():
            return folder
    raise FileNotFoundError(f"no {mark} in {here} or above")
