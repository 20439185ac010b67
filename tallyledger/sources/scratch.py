"""Cutting the lineage of an intermediate result that several later steps read."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir or by setCheckpointDir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, folder: str | None = None) -> str:
    """A new path in the shared folder; what is written there is removed when the program ends."""
    path = f"{(folder or checkpoint_folder(spark)).rstrip('/')}/{uuid.uuid4()}"
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return path


def written_once(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Compute a result now and keep it as a table in the shared folder, safe from lost executors.

    Unlike a checkpointed plan it is computed once, read by column, and joined by its true size.
    """
    path = scratch_path(df.sparkSession, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _written:
        context = spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            continue
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
