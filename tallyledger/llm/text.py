"""Small column expressions that several operators of this folder share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# White space is space, tab, line feed, vertical tab, form feed and carriage return: nothing else.
SPACE = r"[\x20\x09-\x0D]+"
# A word of the benchmark check is a run of ASCII digits, letters and anything beyond ASCII.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; letters beyond ASCII stay as they are."""
    return F.translate(text, _UPPER, _UPPER.lower())


def split_words(text: Column, separator: str) -> Column:
    """Words between runs of the separator; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(folds)


# Rows of an Arrow batch: whole texts can be long, and a batch is held by the executor and its Python worker alike.
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready_workers(spark: SparkSession) -> None:
    """Prepare the session for Python workers on texts: batches of at most 1,000 rows and 16 MB, unless the session has set
    them, and this package importable from where the driver has it, where it is not installed."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "1000")
        spark.conf.set(_BATCH_BYTES, str(16 << 20))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
