"""Which tables and columns of an unknown database look like ledgers and balances."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.vocabulary import (
    BALANCE_COLUMNS,
    COLUMN_WORDS,
    DATASET_WORDS,
    DATE_TYPES,
    MOVEMENT_COLUMNS,
    NUMERIC_TYPES,
    SPARK_DATE_TYPES,
    SPARK_NUMERIC_TYPES,
)

_TABLE = ("table_schema", "table_name")


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Columns of all tables and views of a database, one row each, from the session catalog."""
    database = database or spark.catalog.currentDatabase()
    rows = [
        (database, table.name, column.name, column.dataType, position)
        for table in spark.catalog.listTables(database)  # metadata only
        for position, column in enumerate(spark.catalog.listColumns(f"{database}.{table.name}" if table.database else table.name), 1)
    ]
    return spark.createDataFrame(
        rows, "table_schema string, table_name string, column_name string, data_type string, ordinal int"
    )


def list_columns(catalog: DataFrame, names: list[str], ordered: bool = True) -> DataFrame:
    """Columns and types of the named tables or views."""
    found = catalog.where(F.col("table_name").isin(names)).select(*_TABLE, "ordinal", "column_name", "data_type")
    return found.orderBy(*_TABLE, "ordinal") if ordered else found


def required_columns(dataset: str) -> tuple[str, ...]:
    return MOVEMENT_COLUMNS if dataset.endswith("movements") else BALANCE_COLUMNS


def _hits(name: Column, words: tuple[str, ...]) -> Column:
    return reduce(add, [name.contains(word).cast("int") for word in words])


def discover_table_scores(catalog: DataFrame) -> DataFrame:
    """Score of every table for every dataset: words found in its name, 0 unless both kinds occur."""
    name = F.lower("table_name")
    entries = []
    for dataset, (kind, subject) in DATASET_WORDS.items():
        kinds, subjects = _hits(name, kind), _hits(name, subject)
        score = F.when((kinds > 0) & (subjects > 0), kinds + subjects).otherwise(0)
        entries.append(F.struct(F.lit(dataset).alias("dataset"), score.alias("score")))
    return catalog.select(*_TABLE).distinct().select(*_TABLE, F.inline(F.array(*entries)))


def _preference(canonical: str) -> Column:
    """How well a column suits a canonical one: position of the first word it contains, or null."""
    name = F.lower("column_name")
    place = None
    for position, word in enumerate(COLUMN_WORDS[canonical]):
        hit = name.contains(word)
        place = F.when(hit, position) if place is None else place.when(hit, position)
    dtype = F.regexp_replace(F.lower(F.trim("data_type")), r"\s*\(.*", "")  # decimal(18,2) is a decimal
    if canonical in ("movement_date", "balance_date"):
        place = F.when(dtype.isin(*DATE_TYPES, *SPARK_DATE_TYPES), place)
    elif canonical == "quantity":
        place = F.when(dtype.isin(*NUMERIC_TYPES, *SPARK_NUMERIC_TYPES), place)
    return place


def discover_columns(catalog: DataFrame) -> DataFrame:
    """Best physical column of every table for every canonical column, or null.

    The earliest word wins, then the earliest column. Per table all canonical columns come out of
    one aggregate, without pairing columns with words.
    """
    best = catalog.groupBy(*_TABLE).agg(
        *[
            F.min(
                F.when(
                    _preference(canonical).isNotNull(),
                    F.struct(_preference(canonical).alias("place"), "ordinal", "column_name"),
                )
            ).alias(canonical)
            for canonical in COLUMN_WORDS
        ]
    )
    entries = [
        F.struct(F.lit(canonical).alias("canonical"), F.col(f"{canonical}.column_name").alias("column_name"))
        for canonical in COLUMN_WORDS
    ]
    return best.select(*_TABLE, F.inline(F.array(*entries)))


def discover_datasets(catalog: DataFrame) -> DataFrame:
    """Suggested table and column mapping of every dataset, one row per canonical column.

    The highest score wins, the first table in catalog order on a tie; a dataset no table fits
    has one row of nulls. A canonical column without a match has a null physical column.
    """
    best = (
        discover_table_scores(catalog)
        .where(F.col("score") > 0)
        .groupBy("dataset")
        .agg(F.min(F.struct((-F.col("score")).alias("rank"), *_TABLE)).alias("best"))
        .select("dataset", "best.table_schema", "best.table_name", (-F.col("best.rank")).alias("score"))
    )
    wanted = [
        F.struct(F.lit(dataset).alias("dataset"), F.lit(canonical).alias("canonical"))
        for dataset in DATASET_WORDS
        for canonical in required_columns(dataset)
    ]
    asked = catalog.sparkSession.range(1).select(F.inline(F.array(*wanted)))
    chosen = catalog.join(F.broadcast(best.select(*_TABLE).distinct()), list(_TABLE), "left_semi")  # <= 5 tables
    return (
        asked.join(F.broadcast(best), "dataset", "left")  # five rows
        .where(F.col("score").isNotNull() | (F.col("canonical") == "item_code"))
        .withColumn("canonical", F.when(F.col("score").isNotNull(), F.col("canonical")))
        .join(discover_columns(chosen), [*_TABLE, "canonical"], "left")
        .select("dataset", *_TABLE, "score", "canonical", "column_name")
    )


def discovery_gaps(suggestions: DataFrame) -> DataFrame:
    """Per dataset: suggested table, score and the canonical columns without a match."""
    return suggestions.groupBy("dataset", *_TABLE, "score").agg(
        F.array_join(
            F.sort_array(F.collect_list(F.when(F.col("column_name").isNull(), F.col("canonical")))), ", "
        ).alias("unmapped_columns")
    )
