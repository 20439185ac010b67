"""The dated snapshot table, and import of snapshot CSV files."""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.cells import number_or_zero, strip, type_of
from ..functions.numbers import exact_sum, exact_total
from ..functions.vocabulary import CP1252_AS_LATIN1, CP1252_MEANT, CP1252_UNDEFINED
from ..operators.balances import snapshot_current
from .canonical import Moment, at

_REQUIRED = ("item_code", "warehouse", "quantity")
_TEXTS = ("item_code", "warehouse", "item_description", "category")
_VERSION = "capture_version"
_FIGURES = ("rows", "quantity", "value")
_CAPTURES = f"dataset string, snapshot_date date, rows bigint, quantity double, value double, {_VERSION} string"
_CAPTURE_COLUMNS = tuple(part.split()[0] for part in _CAPTURES.split(", "))


def snapshot_write(
    balances: dict[str, DataFrame], path: str, stamp: Moment, format: str = "parquet"
) -> None:
    """Capture the current balance of every store under one date stamp.

    The balances are staged in a folder of their own, counted while they are written, and become visible with one row per
    store in the table of captures beside the snapshot table: one small file that appears at once. A writer that dies
    before leaves the old state, whatever it has written. A rerun gives the same table: of several captures of one store and
    date the newest counts. The stamp names the date; `balance_date` keeps the time the balance was read.
    """
    day = F.to_date(at(stamp))
    captured = [
        snapshot_current(balance).withColumn("dataset", F.lit(name)).withColumn("snapshot_date", day)
        for name, balance in balances.items()
    ]
    rows = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), captured)
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    counted, counts = Observation(), []
    for k, name in enumerate(balances):
        own = F.col("dataset") == name
        counts += [F.count_if(own).alias(f"rows_{k}"), exact_total(F.col("quantity"), own).alias(f"quantity_{k}")]
        if "value" in rows.columns:
            counts.append(exact_sum(F.col("value"), own).alias(f"value_{k}"))
    (
        rows.hint("rebalance")  # even file sizes, whatever the size of a store
        .observe(counted, *counts)
        .write.partitionBy("dataset", "snapshot_date")
        .format(format)
        .save(f"{path.rstrip('/')}/{_VERSION}={version}")
    )
    found = counted.get
    noted = [(name, *(found.get(f"{what}_{k}") for what in _FIGURES), version) for k, name in enumerate(balances)]
    _commit([row for row in noted if row[1]], day, path, rows.sparkSession)


def _commit(noted: list[tuple], day: Column, path: str, spark: SparkSession) -> None:
    """Make staged captures visible: a row per store, in one file."""
    schema = _CAPTURES.replace(" snapshot_date date,", "")
    rows = spark.createDataFrame(noted, schema).withColumn("snapshot_date", day)
    rows.select(*_CAPTURE_COLUMNS).coalesce(1).write.mode("append").parquet(_captures_path(path))


def captures_write(table: DataFrame, path: str) -> None:
    """Note the captures of a snapshot table that was written by other means, in place of what was noted before.

    History, as-of dates, openings and points need no more than that, and so never read a balance.
    """
    noted = snapshot_write_summary(table).withColumn(_VERSION, F.lit(None).cast("string"))
    noted.select(*_CAPTURE_COLUMNS).coalesce(1).write.mode("overwrite").parquet(_captures_path(path))


def _committed(spark: SparkSession, path: str) -> DataFrame:
    """The captures that count: of one store and date the newest."""
    noted = spark.read.schema(_CAPTURES).parquet(_captures_path(path))
    newest = F.max_by(F.struct(*_FIGURES, _VERSION), F.coalesce(_VERSION, F.lit(""))).alias("newest")
    return noted.groupBy("dataset", "snapshot_date").agg(newest).select("dataset", "snapshot_date", "newest.*")


def snapshot_captures(spark: SparkSession, path: str) -> DataFrame:
    """dataset, snapshot_date, rows, quantity, value of every capture of the snapshot table at a path."""
    return _committed(spark, path).drop(_VERSION)


def _captures_path(path: str) -> str:
    return f"{path.rstrip('/')}_captures"


def snapshot_table(
    spark: SparkSession, path: str, dataset: str | None = None, up_to: Moment | None = None
) -> DataFrame:
    """Stored snapshots that were committed; dataset and date bounds prune partitions, and so do the captures that count.

    A table written by other means, without versions, is read as it is.
    """
    table = spark.read.parquet(path)
    if dataset is not None:
        table = table.where(F.col("dataset") == dataset)
    if up_to is not None:
        table = table.where(F.col("snapshot_date") <= F.to_date(at(up_to)))
    if _VERSION not in table.columns:
        return table
    return table.join(_committed(spark, path), ["dataset", "snapshot_date", _VERSION], "left_semi").drop(_VERSION)


def snapshot_write_summary(table: DataFrame) -> DataFrame:
    """Rows, quantity and value captured per store and date."""
    value = exact_sum(F.col("value")) if "value" in table.columns else F.lit(None).cast("double")
    return table.groupBy("dataset", "snapshot_date").agg(
        F.count(F.lit(1)).alias("rows"), exact_total(F.col("quantity")).alias("quantity"), value.alias("value")
    )


def snapshot_history(table: DataFrame, ordered: bool = True) -> DataFrame:
    """Every capture of every dataset, oldest first; the table of captures is the cheap one to ask."""
    days = table.select("dataset", "snapshot_date").distinct()
    return days.orderBy("dataset", "snapshot_date") if ordered else days


def _stamp(token: Column) -> Column:
    digits = F.when(F.rlike(token, F.lit(r"^[0-9]{8}$")), token)
    return F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))


def file_stamp(file_name: Column, dataset: str) -> Column:
    """Date in a snapshot file name '<dataset>_YYYYMMDD*.csv'; null for any other name."""
    return _stamp(F.regexp_extract(file_name, rf"^\Q{dataset}\E_(.{{8}}).*\.csv$", 1))


def snapshot_files(files: DataFrame, dataset: str, column: str = "file_name") -> DataFrame:
    """Dated snapshot files of a dataset from a listing of file names."""
    return (
        files.select(F.lit(dataset).alias("dataset"), file_stamp(F.col(column), dataset).alias("snapshot_date"), column)
        .where(F.col("snapshot_date").isNotNull())
    )


def newest_snapshot_file(spark: SparkSession, folder: str, dataset: str, as_of: Moment) -> DataFrame:
    """The newest snapshot file of a dataset on or before a date, as one row (dataset, snapshot_date, path), or none.

    Lists the folder without opening a file.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    names = listed.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("file_name"))
    dated = names.withColumn("snapshot_date", file_stamp(F.col("file_name"), dataset))
    newest = dated.where(F.col("snapshot_date") <= F.to_date(at(as_of))).agg(
        F.max(F.struct("snapshot_date", "path")).alias("newest")
    )
    return newest.where("newest IS NOT NULL").select(F.lit(dataset).alias("dataset"), "newest.*")


def baseline_csv_load(spark: SparkSession, folder: str, dataset: str, as_of: Moment) -> DataFrame:
    """The newest snapshot file of a dataset on or before a date, loaded; an error if there is none."""
    newest = newest_snapshot_file(spark, folder, dataset, as_of).first()  # one row
    if newest is None:
        raise ValueError(f"{folder} has no {dataset} snapshot on or before {as_of}")
    return snapshot_csv_load(spark, newest.path)


def file_formats(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header line and encoding of every CSV file, found in one distributed pass over its lines.

    A file is UTF-8 if all of it is; otherwise Windows-1252 unless it holds a byte that code page
    leaves undefined, then Latin-1. `broken` tells whether a quoted cell holds a line break: then some line has an
    odd number of quotes.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("position"),
        "value",
    )
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    undefined = F.length(F.translate(latin, CP1252_UNDEFINED, "")) < F.length(latin)
    return (
        lines.groupBy("file")
        .agg(
            F.min_by("value", "position").alias("header"),
            F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
            F.bool_or(undefined).alias("undefined"),
            F.bool_or(F.length(F.regexp_replace("value", '[^"]+', "")) % 2 == 1).alias("broken"),
        )
        .select(
            "file",
            "header",
            F.when(F.col("utf8"), "utf-8").when(~F.col("undefined"), "cp1252").otherwise("latin-1").alias("encoding"),
            "broken",
        )
    )


def snapshot_csv_load(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Load snapshot CSV files, whatever mix of encodings and column orders they come in.

    All columns are read as text, so codes keep their leading zeros. One small job finds each
    file's header and encoding (one row per file); files alike are then read together, and Spark
    splits large ones unless a quoted cell holds a line break. `file_name` and, where the name ends in
    _YYYYMMDD*.csv, `snapshot_date` tell the captures apart, so that the rows can go into a chain; a folder of part files
    counts as a file of its own name.
    """
    groups: dict[tuple, list[str]] = {}
    for found in file_formats(spark, path).collect():  # one row per file
        groups.setdefault((found.header, found.encoding, found.broken), []).append(found.file)
    if not groups:
        raise ValueError(f"no snapshot rows under {path}")
    parts = [
        _read_alike(spark, sorted(files), encoding, broken) for (_, encoding, broken), files in sorted(groups.items())
    ]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def _read_alike(spark: SparkSession, files: list[str], encoding: str, multiline: bool) -> DataFrame:
    rows = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("encoding", "UTF-8" if encoding == "utf-8" else "ISO-8859-1")
        .csv(files)
    )
    absent = sorted(set(_REQUIRED) - set(rows.columns))
    if absent:
        raise ValueError(f"{files[0]} is missing columns {absent}")
    if encoding == "cp1252":
        rows = rows.select(
            "_metadata",
            *[F.translate(F.col(f"`{name}`"), CP1252_AS_LATIN1, CP1252_MEANT).alias(name) for name in rows.columns],
        )
    own = [f"`{name}`" for name in rows.columns if name not in ("_metadata", "file_name", "snapshot_date")]
    # One row per file, so that no row of a snapshot takes its path apart.
    named = rows.join(F.broadcast(_file_names(spark, files)), F.col("_metadata.file_path") == F.col("_source"))
    return normalize_snapshot(named.select(*own, F.col("_name").alias("file_name"), F.col("_date").alias("snapshot_date")))


def _file_names(spark: SparkSession, files: list[str]) -> DataFrame:
    """(_source, _name, _date) of each file path: the name of the file, or of the folder of part files it lies in, and its date."""
    source = F.col("_source")
    name = F.regexp_extract(source, r"([^/]+\.csv)(?:/[^/]*)?$", 1)
    listed = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(files)), "array<string>")).alias("_source"))
    return listed.select(
        source,
        F.when(name == "", F.regexp_extract(source, "[^/]+$", 0)).otherwise(name).alias("_name"),
        _stamp(F.regexp_extract(name, r"_([0-9]{8})[^_]*\.csv$", 1)).alias("_date"),
    )


def normalize_snapshot(rows: DataFrame) -> DataFrame:
    """Clean a snapshot read as text: quantity and value as numbers, dates or null, trimmed keys."""
    clean = {
        "item_code": strip(F.coalesce(F.col("item_code"), F.lit("nan"))),
        "warehouse": strip(F.coalesce(F.col("warehouse"), F.lit("nan"))),
        "item_description": F.coalesce(F.col("item_description"), F.lit("")) if "item_description" in rows.columns else F.lit(""),
        "balance_date": _loose_moment(F.col("balance_date"), type_of(rows, "balance_date")) if "balance_date" in rows.columns else F.lit(None).cast("timestamp_ntz"),
        "quantity": number_or_zero(F.col("quantity"), type_of(rows, "quantity")),
    }
    if "value" in rows.columns:
        clean["value"] = number_or_zero(F.col("value"), type_of(rows, "value"))
    rest = [name for name in rows.columns if name not in clean]
    return rows.select(
        *[expression.alias(name) for name, expression in clean.items()], *[f"`{name}`" for name in rest]
    )


def _loose_moment(cell: Column, dtype: T.DataType) -> Column:
    return cell.try_cast("timestamp_ntz") if isinstance(dtype, T.StringType) else cell.cast("timestamp_ntz")
