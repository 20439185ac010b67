"""Row-level work on movements: direction, sign, exclusions, drill-down."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LedgerRules
from ..functions.numbers import exact_total

DRILLDOWN_COLUMNS = (
    "movement_date",
    "dataset",
    "job",
    "item_code",
    "warehouse",
    "movement_type",
    "quantity",
    "reference",
    "item_description",
)


def direction_of(movement_type: Column, rules: LedgerRules) -> Column:
    """Bucket of a movement type, singular; unlisted types are 'other'.

    A type listed in two buckets belongs to the later one.
    """
    expression = None
    for bucket, codes in reversed(rules.movement_types.items()):
        if not codes:
            continue
        listed = movement_type.isin([code.upper() for code in codes])
        name = bucket.rstrip("s")
        expression = F.when(listed, name) if expression is None else expression.when(listed, name)
    return F.lit("other") if expression is None else expression.otherwise("other")


def signed(amount: Column, direction: Column, rules: LedgerRules) -> Column:
    """Issues count negative even where the source stores them positive."""
    if not rules.issues_stored_positive:
        return amount
    return F.when(direction == "issue", -F.abs(amount)).otherwise(amount)


def classify_direction(movements: DataFrame, rules: LedgerRules) -> DataFrame:
    return movements.withColumn("direction", direction_of(F.col("movement_type"), rules))


def signed_quantity(movements: DataFrame, rules: LedgerRules) -> DataFrame:
    """Add `direction` and `signed_qty`."""
    return classify_direction(movements, rules).withColumn(
        "signed_qty", signed(F.col("quantity"), F.col("direction"), rules)
    )


def signed_value(movements: DataFrame, rules: LedgerRules) -> DataFrame:
    """Add `direction`, `signed_qty` and `signed_val` (0 without a value column)."""
    rows = signed_quantity(movements, rules)
    if "value" not in rows.columns:
        return rows.withColumn("signed_val", F.lit(0.0))
    return rows.withColumn("signed_val", signed(F.col("value").cast("double"), F.col("direction"), rules))


def is_excluded(rules: LedgerRules) -> Column:
    """True for a movement that any exclusion rule matches in all its parts."""
    parts = {
        "movement_type": lambda given: F.col("movement_type") == str(given).upper(),
        "warehouse": lambda given: F.col("warehouse") == F.lit(given),
        "reference_prefix": lambda given: F.col("reference").startswith(str(given)),
    }
    matches = [
        reduce(and_, [parts[part](given) for part, given in rule.items()])
        for rule in rules.reconcile_exclusions
    ]
    return F.coalesce(reduce(or_, matches), F.lit(False)) if matches else F.lit(False)


def tag_exclusions(movements: DataFrame, rules: LedgerRules) -> DataFrame:
    """Add a boolean `excluded`, so that one scan serves both parts."""
    return movements.withColumn("excluded", is_excluded(rules))


def apply_exclusions(movements: DataFrame, rules: LedgerRules) -> tuple[DataFrame, DataFrame]:
    """Split movements into (kept, excluded)."""
    return movements.where(~is_excluded(rules)), movements.where(is_excluded(rules))


def exclusion_totals(movements: DataFrame, rules: LedgerRules) -> DataFrame:
    """Number and total quantity of kept and of excluded movements."""
    return (
        tag_exclusions(movements, rules)
        .groupBy("excluded")
        .agg(F.count(F.lit(1)).alias("movements"), exact_total(F.col("quantity")).alias("quantity"))
    )


def movement_drilldown(movements: DataFrame, ordered: bool = True) -> DataFrame:
    """Every transaction with the fixed columns that exist, oldest first."""
    rows = movements.select(*[name for name in DRILLDOWN_COLUMNS if name in movements.columns])
    if not ordered:
        return rows
    return rows.orderBy(*rows.columns)


def drilldown_totals(movements: DataFrame) -> DataFrame:
    """Net quantity and number of transactions of a drill-down."""
    return movements.agg(
        exact_total(F.col("quantity")).alias("net_quantity"), F.count(F.lit(1)).alias("movements")
    )
