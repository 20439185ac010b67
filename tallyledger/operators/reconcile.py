"""Opening balance plus movements against closing balance, for one period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import LedgerRules
from ..functions.cells import non_blank
from ..functions.numbers import part_sums, total_of_parts
from ..functions.reuse import dealt
from ..functions.vocabulary import KEY
from ..sources.canonical import Moment, at, in_window
from .balances import snapshot_asof
from .movements import is_excluded, signed_quantity
from .summaries import largest_first

_AMOUNTS = ("opening_qty", "net_movement", "closing_qty")
# Order in which the legs are asked for an item's description.
_RANKS = {"opening_qty": 0, "closing_qty": 1, "net_movement": 2}


def leg(rows: DataFrame, amount: str, measure: Column, *extra: str) -> DataFrame:
    """One side of a reconciliation in the common shape: key, description, three amounts."""
    description = F.col("item_description") if "item_description" in rows.columns else F.lit("")
    return rows.select(
        *KEY,
        *extra,
        non_blank(description).alias("item_description"),
        F.lit(_RANKS[amount]).alias("source"),
        *[(measure if name == amount else F.lit(0.0)).alias(name) for name in _AMOUNTS],
    )


def balance_legs(legs: list[DataFrame], rules: LedgerRules, *extra: str) -> DataFrame:
    """Add up the legs per key (and `extra`, the period of a chain) and work out the variance.

    A full outer join of opening, net movement and closing is the same as one aggregate over
    their union: amounts of a key and text combine by hash before the shuffle, whatever a single
    key weighs. One row per key, period and text then moves to its item, and that exchange serves
    the totals per key, the description per item and any later total per key; an item brings at
    most its warehouses times the periods times its texts.
    """
    named = F.when(
        F.col("item_description").isNotNull(), F.struct("source", "item_description")
    )
    # A row has one amount, that of its leg: one set of part sums is enough.
    of_leg = {name: F.col("source") == rank for name, rank in _RANKS.items()}
    amount = F.coalesce(*[F.when(own, F.col(name)) for name, own in of_leg.items()])
    combined = (
        reduce(DataFrame.unionByName, legs)
        .where(F.col("item_code").isNotNull() & F.col("warehouse").isNotNull())
        .withColumn("amount", amount)
        .groupBy(*KEY, *extra, "source", "item_description")
        .agg(*part_sums("amount"))
    )
    totals = (
        dealt(combined, "item_code")
        .groupBy(*KEY, *extra)
        .agg(*[total_of_parts("amount", of_leg[name]).alias(name) for name in _AMOUNTS], F.min(named).alias("named"))
    )
    per_item = Window.partitionBy("item_code", *extra)
    expected = F.col("opening_qty") + F.col("net_movement")
    variance = F.col("closing_qty") - expected
    return totals.select(
        *KEY,
        *extra,
        *_AMOUNTS,
        expected.alias("expected_closing"),
        variance.alias("variance"),
        (F.abs(variance) <= F.lit(rules.variance_tolerance)).alias("within_tolerance"),
        F.coalesce(F.min("named").over(per_item)["item_description"], F.lit("")).alias("item_description"),
    )


def reconcile(
    opening: DataFrame,
    movements: DataFrame,
    closing: DataFrame,
    rules: LedgerRules,
    ordered: bool = False,
) -> DataFrame:
    """Per item and warehouse: opening, net movement, closing, expected closing and variance."""
    result = balance_legs(
        [
            leg(opening, "opening_qty", F.col("quantity")),
            leg(closing, "closing_qty", F.col("quantity")),
            leg(signed_quantity(movements, rules), "net_movement", F.col("signed_qty")),
        ],
        rules,
    )
    return largest_first(result, "variance", *KEY) if ordered else result


def item_description_lookup(opening: DataFrame, closing: DataFrame, movements: DataFrame) -> DataFrame:
    """Description per item: the smallest non-blank one of the first leg that has any."""
    legs = [
        leg(rows, amount, F.lit(0.0)).select("item_code", "item_description", "source")
        for rows, amount in ((opening, "opening_qty"), (closing, "closing_qty"), (movements, "net_movement"))
    ]
    named = F.when(F.col("item_description").isNotNull(), F.struct("source", "item_description"))
    return (
        reduce(DataFrame.unionByName, legs)
        .where(F.col("item_code").isNotNull())
        .groupBy("item_code", "source", "item_description")  # by hash, before the sort that picking takes
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 0")  # else the optimizer would merge both steps
        .groupBy("item_code")
        .agg(F.min(named).alias("named"))
        .select("item_code", F.coalesce("named.item_description", F.lit("")).alias("item_description"))
    )


def snapshot_moment(snapshot: DataFrame, what: str) -> Column:
    """When a snapshot was taken, as a scalar subquery inside the plan; an error if it is undated."""
    moment = snapshot.select(F.max("balance_date").alias("moment")).scalar()
    return F.coalesce(
        moment, F.raise_error(F.lit(f"{what} has no balance_date; give the date")).cast("timestamp_ntz")
    )


def window_bounds(
    opening: DataFrame,
    closing: DataFrame | None,
    date_from: Moment | None = None,
    date_to: Moment | None = None,
    now: Moment | None = None,
) -> tuple[Column, Column]:
    """Movement window between two snapshots, or between a snapshot and live stock at `now`.

    Explicit dates win; otherwise the window runs from the newest date of the opening snapshot to
    the newest date of the closing one. Both ends stay inside the plan.
    """
    if date_to is None and closing is None and now is None:
        raise ValueError("live closing stock needs date_to or now")
    start = at(date_from) if date_from is not None else snapshot_moment(opening, "opening snapshot")
    if date_to is not None:
        return start, at(date_to)
    return start, at(now) if closing is None else snapshot_moment(closing, "closing snapshot")


def reconcile_window(
    opening: DataFrame,
    closing: DataFrame | None,
    date_from: Moment | None = None,
    date_to: Moment | None = None,
    now: Moment | None = None,
) -> DataFrame:
    """The movement window as one row."""
    start, end = window_bounds(opening, closing, date_from, date_to, now)
    return opening.sparkSession.range(1).select(start.alias("window_from"), end.alias("window_to"))


def reconcile_snapshots(
    opening: DataFrame,
    movements: DataFrame,
    closing: DataFrame,
    rules: LedgerRules,
    *,
    live: bool = False,
    date_from: Moment | None = None,
    date_to: Moment | None = None,
    now: Moment | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Reconcile two snapshots, or a snapshot with live stock, over the window between them.

    Lots of either balance need no aggregation beforehand. Excluded movements do not count.
    """
    start, end = window_bounds(opening, None if live else closing, date_from, date_to, now)
    kept = in_window(movements, F.col("movement_date"), start, end).where(~is_excluded(rules))
    return reconcile(opening, kept, closing, rules, ordered)


def reconcile_dated(
    balances: DataFrame,
    movements: DataFrame,
    rules: LedgerRules,
    date_from: Moment,
    date_to: Moment,
    ordered: bool = False,
) -> DataFrame:
    """Reconcile a balance table that carries its own dates: as of the start against as of the end."""
    dated = balances.where(F.col("balance_date") < at(date_to))
    kept = in_window(movements, F.col("movement_date"), date_from, date_to).where(~is_excluded(rules))
    return reconcile(
        snapshot_asof(dated, date_from), kept, snapshot_asof(dated, date_to), rules, ordered
    )
