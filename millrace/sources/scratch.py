"""The folder that driver and executors share, for intermediate tables and checkpoints."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_cleared: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; it is deleted when the application ends. Where the
    session has none, a local folder is set if the master is local (as in tests), and anything else is an error: executors
    on other machines would not see it."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    top = f"{at}/millrace-{context.applicationId}"
    if top not in _cleared:
        _cleared.add(top)

        def clear() -> None:
            try:
                path = context._jvm.org.apache.hadoop.fs.Path(top)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
            except Exception:  # the JVM may be gone at interpreter exit; the folder is then the cluster's to clear
                pass

        atexit.register(clear)
    return top


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def folder_for(spark: SparkSession, name: str) -> Iterator[str]:
    """A path in the shared folder for the length of a block: what lies there is deleted at its end."""
    path = new_path(spark, name)
    try:
        yield path
    finally:
        delete(spark, path)


@contextmanager
def kept_for(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """keep() for the length of a block: what was written is deleted at its end, so nothing may read it later."""
    with folder_for(df.sparkSession, name) as path:
        df.write.option("compression", "zstd").parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
