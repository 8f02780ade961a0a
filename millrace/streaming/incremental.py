"""Growing folders: each run takes the files that came since the last one, once, and appends what a step makes of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.gate import schema_gate


def read_new_lines(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of value, file: the lines of the text files in the folder, blank ones left out. A file has to be there
    whole when it appears (moved into the folder, as Spark's own writers do)."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")


def take_available(stream: DataFrame, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Runs step over what is new and ends. What has been read is kept in the checkpoint. Each batch writes a folder of
    its own and writes it again if a run that was stopped has to repeat it, so no row is lost or doubled."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def gate_new(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """Records (JSON lines with a field output) that came into the folder since the last run go through the schema gate;
    returns all rows so far, with batch. A line that doesn't fit the schema has null fields and its text in _broken."""

    def step(lines: DataFrame) -> DataFrame:
        parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
        return schema_gate(lines.select(parsed.alias("row"), "file").select("row.*", "file"))

    take_available(read_new_lines(spark, folder, files_a_batch), out, checkpoint, step)
    return spark.read.parquet(out)
