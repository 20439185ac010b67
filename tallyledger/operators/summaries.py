"""Totals of movements by item, period, category and type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LedgerRules
from ..functions.cells import strip
from ..functions.numbers import exact_total
from ..functions.vocabulary import DIRECTIONS, KEY, UNSPECIFIED
from .movements import signed_quantity

_PERIODS = {"MS": "month", "W": "week", "D": "day"}


def largest_first(df: DataFrame, measure: str, *ties: str) -> DataFrame:
    """Sort by the size of a measure, whatever its sign; ties by name."""
    return df.orderBy(F.abs(measure).desc(), *ties)


def period_start(moment: Column, freq: str) -> Column:
    """First instant of the month, Monday week or day of a movement; an unknown freq means month.

    Truncating as a date keeps wall-clock time out of reach of the session zone.
    """
    unit = _PERIODS.get(freq, "month")
    day = F.to_date(moment)
    return (day if unit == "day" else F.trunc(day, unit)).cast("timestamp_ntz")


def direction_totals(amount: Column, names: Sequence[str] = DIRECTIONS) -> list[Column]:
    """One conditional sum per direction: a pivot without a job to find its columns."""
    return [
        exact_total(amount, F.col("direction") == name).alias(name) for name in names
    ]


def net_of_directions() -> Column:
    return F.col("receipt") + F.col("issue") + F.col("adjustment") + F.col("other")


def movement_summary(
    movements: DataFrame,
    rules: LedgerRules,
    freq: str = "MS",
    extra_directions: Sequence[str] = (),
    ordered: bool = False,
) -> DataFrame:
    """Receipts, issues, adjustments, other and net per item, warehouse and period.

    Buckets of the rules outside the standard four, and those named in `extra_directions`, show too but never enter net.
    """
    buckets = [bucket.rstrip("s") for bucket in rules.movement_types]
    shown = list(dict.fromkeys([*DIRECTIONS, *buckets, *extra_directions]))
    rows = signed_quantity(movements, rules).withColumn("period", period_start(F.col("movement_date"), freq))
    summary = (
        rows.groupBy(*KEY, "period")
        .agg(*direction_totals(F.col("signed_qty"), shown))
        .withColumn("net", net_of_directions())
    )
    return summary.orderBy(*KEY, "period") if ordered else summary


def labelled(text: Column) -> Column:
    """Category label; blank becomes '(unspecified)'."""
    label = strip(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(label == "", UNSPECIFIED).otherwise(label)


def category_summary(
    movements: DataFrame, rules: LedgerRules, by: str = "category", ordered: bool = True
) -> DataFrame:
    """Movement count, directions, net and raw net value per category or any other column."""
    if by not in movements.columns:
        raise KeyError(f"movements have no {by!r} column; map it in the dataset")
    totals = [F.count(F.lit(1)).alias("movements"), *direction_totals(F.col("signed_qty"))]
    if "value" in movements.columns:
        totals.append(exact_total(F.col("value")).alias("net_value"))
    summary = (
        signed_quantity(movements, rules)
        .withColumn(by, labelled(F.col(by)))
        .groupBy(by)
        .agg(*totals)
        .withColumn("net", net_of_directions())
    )
    columns = [by, "movements", *DIRECTIONS, "net"] + (["net_value"] if "value" in movements.columns else [])
    summary = summary.select(*columns)
    return largest_first(summary, "net", by) if ordered else summary


def movement_types(movements: DataFrame, ordered: bool = True) -> DataFrame:
    """Rows, total, smallest and largest quantity per movement type of each ledger."""
    keys = [name for name in ("dataset", "movement_type") if name in movements.columns]
    types = movements.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        exact_total(F.col("quantity")).alias("total_units"),
        F.min("quantity").alias("min_qty"),
        F.max("quantity").alias("max_qty"),
    )
    return types.orderBy(*keys[:-1], F.col("rows").desc(), keys[-1]) if ordered else types


def movement_net(movements: DataFrame, rules: LedgerRules) -> DataFrame:
    """Net movement per item and warehouse."""
    return (
        signed_quantity(movements, rules)
        .groupBy(*KEY)
        .agg(exact_total(F.col("signed_qty")).alias("net_movement"))
    )
