"""From a physical table to canonical movements or balances."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection
from functools import reduce
from operator import and_, mul

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import Dataset, Mapping
from ..functions.cells import (
    free_text,
    is_tidy,
    key_text,
    moment,
    number_or_zero,
    quoted,
    tighten_separator,
    type_code,
    type_of,
)
from ..functions.vocabulary import SCOPES
from .keys import raw_key_condition

Moment = dt.date | dt.datetime | str | Column

_TEXT_COLUMNS = ("item_description", "reference", "job", "category")


def at(value: Moment) -> Column:
    """A point in time as a zone-free timestamp; a Column (for instance a scalar subquery) passes through."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def mapped(mapping: Mapping) -> Column:
    """The expression one canonical column is computed from."""
    if mapping is None:
        return F.lit(None).cast("string")
    if isinstance(mapping, list):
        return F.concat_ws("|", *[quoted(part) for part in mapping])
    if isinstance(mapping, dict):
        return reduce(
            mul,
            [
                quoted(factor).cast("double") if isinstance(factor, str) else F.lit(float(factor))
                for factor in mapping["product"]
            ],
        )
    return quoted(mapping)


def project(table: DataFrame, ds: Dataset) -> DataFrame:
    """Select the canonical columns, unchanged otherwise."""
    return table.select(*[mapped(source).alias(name) for name, source in ds.columns.items()])


def without_excluded(table: DataFrame, ds: Dataset) -> DataFrame:
    """Drop rows that equal an excluded value; rows without a value stay."""
    keep = [
        quoted(rule["column"]).isNull() | (quoted(rule["column"]) != F.lit(rule["equals"]))
        for rule in ds.exclude_where
    ]
    return table.where(reduce(and_, keep)) if keep else table


def in_window(table: DataFrame, column: Column, date_from: Moment | None, date_to: Moment | None) -> DataFrame:
    """Rows dated on or after `date_from` and before `date_to`; either bound may be missing."""
    if date_from is not None:
        table = table.where(column >= at(date_from))
    if date_to is not None:
        table = table.where(column < at(date_to))
    return table


def canonical_scan(
    table: DataFrame,
    ds: Dataset,
    *,
    date_from: Moment | None = None,
    date_to: Moment | None = None,
    item_code: str | None = None,
    warehouse: str | None = None,
    as_of: Moment | None = None,
) -> DataFrame:
    """Filter, project and normalize a physical table.

    The date window and the exclusions apply to raw columns so that they reach the scan. Item and warehouse compare
    with the cleaned key, behind a weaker condition on raw columns that reaches the scan as well. A dataset without a date
    ignores the window; its rows are stamped `as_of`.
    """
    if warehouse and ds.columns["warehouse"] is None:
        raise ValueError(f"Dataset {ds.name} has no warehouse column to filter on")
    rows = without_excluded(table, ds)
    if ds.has_date:
        rows = in_window(rows, mapped(ds.columns[ds.date_column]), date_from, date_to)
    for name, wanted in (("item_code", item_code), ("warehouse", warehouse)):
        raw = raw_key_condition(table, ds.columns[name], wanted) if wanted else None
        rows = rows if raw is None else rows.where(raw)
    tidy = tidy_columns(table, ds)
    rows = project(rows, ds)
    if ds.kind == "movement":
        rows = normalize_movements(rows, tidy)
    else:
        rows = normalize_balances(rows, None if ds.has_date else as_of, ds.has_date, tidy)
    if item_code:
        rows = rows.where(F.col("item_code") == item_code)
    if warehouse:
        rows = rows.where(F.col("warehouse") == warehouse)
    return rows


def tidy_columns(table: DataFrame, ds: Dataset) -> set[str]:
    """Canonical columns whose physical types leave nothing to trim, such as a key of two numbers."""
    tidy = set()
    for name, mapping in ds.columns.items():
        parts = mapping if isinstance(mapping, list) else [mapping]
        if all(isinstance(part, str) and is_tidy(type_of(table, part)) for part in parts):
            tidy.add(name)
    return tidy


def _normalize(rows: DataFrame, date_column: str, stamp: Column | None, tidy: Collection[str]) -> DataFrame:
    item = key_text(F.col("item_code"), "item_code" in tidy)
    clean = {
        "item_code": item if "item_code" in tidy else tighten_separator(item),
        "warehouse": key_text(F.col("warehouse"), "warehouse" in tidy),
        "quantity": number_or_zero(F.col("quantity"), type_of(rows, "quantity")),
        date_column: stamp if stamp is not None else moment(F.col(date_column), type_of(rows, date_column)),
    }
    if "value" in rows.columns:
        clean["value"] = number_or_zero(F.col("value"), type_of(rows, "value"))
    if "movement_type" in rows.columns:
        clean["movement_type"] = type_code(F.col("movement_type"))
    clean |= {name: free_text(F.col(name), name in tidy) for name in _TEXT_COLUMNS if name in rows.columns}
    return rows.select(*[clean.get(name, F.col(name)).alias(name) for name in rows.columns])


def normalize_movements(rows: DataFrame, tidy: Collection[str] = ()) -> DataFrame:
    """Clean keys, texts, type codes and numbers of canonical movements.

    Columns named in `tidy` are known to need no trimming.
    """
    return _normalize(rows, "movement_date", None, tidy)


def normalize_balances(
    rows: DataFrame, as_of: Moment | None = None, dated: bool = True, tidy: Collection[str] = ()
) -> DataFrame:
    """Clean canonical balances; a current-state balance gets `as_of`, whole seconds, as its date."""
    if dated:
        return _normalize(rows, "balance_date", None, tidy)
    if as_of is None:
        raise ValueError("a current-state balance needs as_of, the time it was read")
    seconds = F.left(at(as_of).cast("string"), F.lit(len("2026-01-01 00:00:00")))  # free of the session zone
    return _normalize(rows, "balance_date", seconds.cast("timestamp_ntz"), tidy)


def ledger_union(ledgers: dict[str, DataFrame], scope: str = "all") -> DataFrame:
    """The ledgers of a scope as one bag of rows, each tagged with its dataset."""
    tagged = [ledgers[name].withColumn("dataset", F.lit(name)) for name in SCOPES[scope]]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), tagged)


def missing_columns(table: DataFrame, ds: Dataset) -> list[str]:
    """Physical columns a mapping names that the table lacks."""
    named: list[str] = []
    for mapping in ds.columns.values():
        if isinstance(mapping, str):
            named.append(mapping)
        elif isinstance(mapping, list):
            named += mapping
        elif isinstance(mapping, dict):
            named += [factor for factor in mapping["product"] if isinstance(factor, str)]
    return [name for name in dict.fromkeys(named) if name not in table.columns]


MOVEMENT_SCHEMA = T.StructType(
    [
        T.StructField("item_code", T.StringType()),
        T.StructField("item_description", T.StringType()),
        T.StructField("warehouse", T.StringType()),
        T.StructField("movement_date", T.TimestampNTZType()),
        T.StructField("movement_type", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("reference", T.StringType()),
    ]
)
BALANCE_SCHEMA = T.StructType(
    [
        T.StructField("item_code", T.StringType()),
        T.StructField("item_description", T.StringType()),
        T.StructField("warehouse", T.StringType()),
        T.StructField("balance_date", T.TimestampNTZType()),
        T.StructField("quantity", T.DoubleType()),
    ]
)
