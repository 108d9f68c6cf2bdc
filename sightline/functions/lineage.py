"""Cutting lineage with reliable checkpoints or written tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="sightline")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _temporary()
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a checkpoint."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that it lies in."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table that lasts until the driver ends.

    For loops: a checkpoint keeps the constraints that the optimizer has inferred, which multiply from round to round; a table keeps none.
    """
    path, schema = f"{shared_folder(df.sparkSession)}/stored_{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    atexit.register(remove, df.sparkSession, path)
    return df.sparkSession.read.schema(schema).parquet(path)
