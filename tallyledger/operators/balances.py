"""Balances per item and warehouse, today or as of a date, and reports over stored snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import non_blank
from ..functions.numbers import exact_sum, exact_total, part_sums, total_of_parts
from ..functions.reuse import dealt
from ..functions.vocabulary import KEY, STORES
from ..sources.canonical import Moment, at
from .asof import asof_join

_STORE_COLUMNS = ("dataset", "label", "unit", "ledger")


def _combined(balances: DataFrame, *dates: Column) -> DataFrame:
    """Lots added up per key, date and texts: numbers alone, so rows combine by hash before the shuffle.

    What is left, a row per different text, can afford the sort that picking a text takes.
    """
    texts = [
        non_blank(F.col(name)).alias(name) for name in ("item_description", "category") if name in balances.columns
    ]
    amounts = [name for name in ("quantity", "value") if name in balances.columns]
    newest = [F.max("balance_date").alias("balance_date")] if not dates else []
    sums = [part for name in amounts for part in part_sums(name)]
    return balances.groupBy(*KEY, *dates, *texts).agg(*newest, *sums)


def _totals(combined: DataFrame) -> list[Column]:
    return [total_of_parts(name).alias(name) for name in ("quantity", "value") if f"{name}_0" in combined.columns]


def _picked_texts(combined: DataFrame) -> list[Column]:
    return [
        F.coalesce(F.min(name), F.lit("")).alias(name)
        for name in ("item_description", "category")
        if name in combined.columns
    ]


def _arranged(df: DataFrame) -> DataFrame:
    order = (*KEY, "item_description", "balance_date", "quantity", "value", "category")
    return df.select(*[name for name in order if name in df.columns])


def snapshot_current(balances: DataFrame, ordered: bool = False) -> DataFrame:
    """One row per item and warehouse: totals of its lots, newest date, a description, a category.

    Of several texts the smallest that is not blank counts.
    """
    combined = _combined(balances)
    snapshot = _arranged(
        combined.groupBy(*KEY).agg(
            F.max("balance_date").alias("balance_date"), *_totals(combined), *_picked_texts(combined)
        )
    )
    return snapshot.orderBy(F.col("quantity").desc(), *KEY) if ordered else snapshot


def snapshot_asof(balances: DataFrame, as_of: Moment, ordered: bool = False) -> DataFrame:
    """Balances as of a moment: each key at its own latest date on or before it.

    Lots first add up per key, date and texts, then per key and date, then each key keeps its latest date. All are
    aggregates that combine before their shuffle, so no key has to fit a window in one task.
    """
    before = balances.where(F.col("balance_date") <= at(as_of))
    # One exchange by key, of rows that are combined already, serves both steps; without texts the first is done before it.
    if {"item_description", "category"}.isdisjoint(before.columns):
        totals = [exact_total(F.col(name)).alias(name) for name in ("quantity", "value") if name in before.columns]
        dated = dealt(before.groupBy(*KEY, "balance_date").agg(*totals), *KEY)
    else:
        combined = _combined(before, F.col("balance_date"))
        dated = dealt(combined, *KEY).groupBy(*KEY, "balance_date").agg(*_totals(combined), *_picked_texts(combined))
    # Column by column, so that readers pay for those they use, and numbers alone need no sort.
    picked = [F.max_by(name, "balance_date").alias(name) for name in dated.columns if name not in KEY]
    snapshot = _arranged(dated.groupBy(*KEY).agg(*picked))
    return snapshot.orderBy(F.col("quantity").desc(), *KEY) if ordered else snapshot


def baseline_asof(snapshots: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (dataset, as_of) the newest snapshot date on or before it, or null; give the table of captures.

    Any number of captures and of requests may meet on one dataset: both are merged by date (see asof_join).
    """
    dates = snapshots.select("dataset", "snapshot_date").distinct()
    return asof_join(requests, dates, ["dataset"], "as_of", "snapshot_date", ["snapshot_date"], bucket="year")


def balance_before(
    movements: DataFrame, snapshots: DataFrame, on: Sequence[str] = KEY, columns: Sequence[str] = ("snapshot_date", "balance")
) -> DataFrame:
    """Every movement with the date and the quantity of its key's last snapshot on or before it, null if there is none."""
    held = snapshots.groupBy(*on, F.col("snapshot_date").alias(columns[0])).agg(exact_total(F.col("quantity")).alias(columns[1]))
    return asof_join(movements, held, on, "movement_date", columns[0], columns)


def balance_points(history: DataFrame, live: DataFrame, end: Moment) -> DataFrame:
    """Total quantity and value of every stored snapshot, plus the live balance dated `end`.

    `history` is the table of captures, or snapshots themselves.
    """

    def totals(df: DataFrame, *keys: str) -> DataFrame:
        value = exact_sum(F.col("value")) if "value" in df.columns else F.lit(None).cast("double")
        return df.groupBy(*keys).agg(exact_total(F.col("quantity")).alias("quantity"), value.alias("value"))

    stored = totals(history, "dataset", "snapshot_date").withColumn("live", F.lit(False))
    today = (
        totals(live, "dataset")
        .withColumn("snapshot_date", F.to_date(at(end)))
        .withColumn("live", F.lit(True))
    )
    return stored.unionByName(today).select("dataset", "snapshot_date", "quantity", "value", "live")


def stock_balances_report(history: DataFrame, current: DataFrame, date_from: Moment) -> DataFrame:
    """Opening, closing and change per store in quantity and value.

    Opening is the newest snapshot on or before `date_from` (null if none), closing the current
    balance. `history` is the table of captures, or snapshots themselves: the date of each opening is a scalar subquery
    over partition values, so that only the chosen partitions are read.
    """
    day = F.to_date(at(date_from))

    def newest(dataset: str) -> Column:
        dates = history.where((F.col("dataset") == dataset) & (F.col("snapshot_date") <= day))
        return dates.select(F.max("snapshot_date")).scalar()

    chosen = [
        (F.col("dataset") == dataset) & (F.col("snapshot_date") == newest(dataset)) for dataset, *_ in STORES
    ]
    stores = store_frame(history)
    value = "value" in history.columns
    opening = (
        history.where(reduce(or_, chosen))
        .groupBy("dataset", "snapshot_date")
        .agg(
            exact_total(F.col("quantity")).alias("opening_qty"),
            (exact_sum(F.col("value")) if value else F.lit(None).cast("double")).alias("opening_value"),
        )
        .withColumnRenamed("snapshot_date", "opening_source")
    )
    closing_value = exact_sum(F.col("value")) if "value" in current.columns else F.lit(None).cast("double")
    closing = current.groupBy("dataset").agg(
        exact_total(F.col("quantity")).alias("closing_qty"), closing_value.alias("closing_value")
    )
    return (
        stores.join(closing, "dataset", "left")
        .join(opening, "dataset", "left")
        .select(
            F.col("label").alias("stock_type"),
            "opening_qty",
            F.coalesce("closing_qty", F.lit(0.0)).alias("closing_qty"),
            (F.coalesce("closing_qty", F.lit(0.0)) - F.col("opening_qty")).alias("qty_change"),
            "unit",
            "opening_value",
            "closing_value",
            (F.col("closing_value") - F.col("opening_value")).alias("value_change"),
            "opening_source",
        )
    )


def store_frame(like: DataFrame) -> DataFrame:
    """The three stores of the reports, one row each."""
    rows = [
        F.struct(*[F.lit(cell).cast("string").alias(name) for name, cell in zip(_STORE_COLUMNS, store)])
        for store in STORES
    ]
    return like.sparkSession.range(1).select(F.inline(F.array(*rows)))
