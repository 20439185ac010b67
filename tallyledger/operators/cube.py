"""Daily totals per category, the ranking that keeps them short, and checks built on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LedgerRules
from ..functions.numbers import exact_total, part_sums, rounded, total_of_parts
from ..functions.reuse import shared
from ..functions.vocabulary import OTHER, OUTSIDE_COVERAGE, SAME_BASELINE, TOP_CATEGORIES
from ..sources.canonical import at
from .balances import store_frame
from .movements import signed_value
from .summaries import labelled

# Letter of each direction in the cube's column names; all others count under 'o'.
_LETTERS = {"receipt": "r", "issue": "i", "adjustment": "a"}

CUBE_MEASURES = ("ru", "iu", "au", "ou", "rv", "iv", "av", "ov")

# Net totals at or below this are not shown.
MIN_NET = 0.5

TOLERANCE_PERCENT = 0.5


def _categorized(movements: DataFrame, rules: LedgerRules) -> DataFrame:
    category = labelled(F.col("category")) if "category" in movements.columns else F.lit("(unspecified)")
    return signed_value(movements, rules).withColumn("category", category)


def category_rank_topn(movements: DataFrame, rules: LedgerRules, top: int = TOP_CATEGORIES) -> DataFrame:
    """The largest categories by gross value, or by gross units where no movement carries value.

    Without any value every category ties at zero, so ordering by value and then by units makes
    that choice without a grand total.
    """
    return _largest(_day_directions(movements, rules), top)


def _day_directions(movements: DataFrame, rules: LedgerRules) -> DataFrame:
    """Part sums of net and gross amounts per day, category and direction: the one pass over the ledger."""
    rows = _categorized(movements, rules).withColumns(
        {"gross_qty": F.abs("signed_qty"), "gross_val": F.abs("signed_val")}
    )
    sums = [part for name in ("signed_qty", "signed_val", "gross_qty", "gross_val") for part in part_sums(name)]
    return shared(rows.groupBy(F.to_date("movement_date").alias("day"), "category", "direction").agg(*sums))


def _largest(directions: DataFrame, top: int) -> DataFrame:
    gross = directions.groupBy("category").agg(
        total_of_parts("gross_val").alias("gross_value"), total_of_parts("gross_qty").alias("gross_units")
    )
    return gross.orderBy(F.col("gross_value").desc(), F.col("gross_units").desc(), "category").limit(top)


def category_order(movements: DataFrame, rules: LedgerRules, top: int = TOP_CATEGORIES) -> DataFrame:
    """Display order of the categories; one more than `top` shows that the rest folds into 'Other'."""
    ranked = category_rank_topn(movements, rules, top + 1)
    place = F.struct((-F.col("gross_value")).alias("value"), (-F.col("gross_units")).alias("units"), "category")
    return (
        ranked.agg(F.sort_array(F.collect_list(place)).alias("listed"))
        .select(F.posexplode("listed").alias("place", "entry"))
        .select("place", F.when(F.col("place") < top, F.col("entry.category")).otherwise(OTHER).alias("category"))
    )


def fold_categories(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """Rename every category outside the ranking to 'Other'."""
    kept = ranked.select("category", F.lit(True).alias("kept"))
    return (
        rows.join(F.broadcast(kept), "category", "left")  # at most `top` rows
        .withColumn("category", F.when(F.col("kept"), F.col("category")).otherwise(OTHER))
        .drop("kept")
    )


def category_day_cube(movements: DataFrame, rules: LedgerRules, top: int = TOP_CATEGORIES) -> DataFrame:
    """One row per day and category: receipts, issues, adjustments and other, in units and value.

    Totals per day, category and direction form first; ranking and folding both work on those.
    """
    directions = _day_directions(movements, rules)
    folded = (
        fold_categories(directions, _largest(directions, top))
        .groupBy("day", "category", "direction")
        .agg(total_of_parts("signed_qty").alias("units"), total_of_parts("signed_val").alias("value"))
        .withColumn("units", rounded(F.col("units"), 1))
        .withColumn("value", rounded(F.col("value"), 2))
    )
    listed = F.col("direction").isin(*_LETTERS)

    def cell(letter: str, measure: str) -> Column:
        names = [name for name, given in _LETTERS.items() if given == letter]
        mine = F.col("direction").isin(names) if names else ~listed
        return F.coalesce(F.sum(F.when(mine, F.col(measure))), F.lit(0.0)).alias(letter + measure[0])

    return folded.groupBy("day", "category").agg(
        *[cell(letter, measure) for measure in ("units", "value") for letter in ("r", "i", "a", "o")]
    )


def cube_net(measure: str = "units") -> Column:
    """Net of a cube row in one measure."""
    letter = {"units": "u", "value": "v"}[measure]
    return F.col("r" + letter) + F.col("i" + letter) + F.col("a" + letter) + F.col("o" + letter)


def window_category_net(
    cube: DataFrame,
    date_from: dt.date | str,
    date_to: dt.date | str,
    measure: str = "units",
    exclude_end: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Re-total the cube over a window of days; categories with next to no net are left out.

    Swapped bounds are put right. The end day counts unless `exclude_end`.
    """
    start, end = F.to_date(at(date_from)), F.to_date(at(date_to))
    start, end = F.least(start, end), F.greatest(start, end)
    day = F.col("day")
    inside = (day >= start) & ((day < end) if exclude_end else (day <= end))
    totals = (
        cube.where(inside)
        .groupBy("category")
        .agg(*[exact_total(F.col(name)).alias(name) for name in CUBE_MEASURES])
        .withColumn("net", cube_net(measure))
        .where(F.abs("net") > MIN_NET)
    )
    return totals.orderBy(F.abs("net").desc(), "category") if ordered else totals


def store_reconciliation(
    points: DataFrame,
    cube: DataFrame,
    date_from: dt.date | str,
    date_to: dt.date | str,
    coverage: tuple[dt.date | str, dt.date | str] | None = None,
) -> DataFrame:
    """Does each store's opening balance plus net movement explain its closing balance?

    `points` are dated totals (dataset, snapshot_date, quantity, live), `cube` the daily totals with
    a `ledger` tag. Opening and closing are the newest points on or before the two dates; movements
    count from the opening day up to, not including, the closing day.
    """
    start, end = F.to_date(at(date_from)), F.to_date(at(date_to))
    start, end = F.least(start, end), F.greatest(start, end)

    def newest(limit: Column) -> Column:  # on one day a stored snapshot comes before the live balance
        order = F.struct("snapshot_date", (~F.col("live")).alias("stored"))
        return F.max_by(F.struct("snapshot_date", "quantity"), F.when(F.col("snapshot_date") <= limit, order))

    ends = points.groupBy("dataset").agg(newest(start).alias("opening"), newest(end).alias("closing"))
    stores = store_frame(points).join(ends, "dataset", "left").select(
        "dataset",
        "label",
        "ledger",
        F.col("opening.snapshot_date").alias("opening_date"),
        F.col("opening.quantity").alias("opening_qty"),
        F.col("closing.snapshot_date").alias("closing_date"),
        F.col("closing.quantity").alias("closing_qty"),
    )
    opened, closed = F.col("opening_date"), F.col("closing_date")
    covered = F.lit(True)
    if coverage is not None:
        first, last = (F.to_date(at(bound)) for bound in coverage)
        covered = opened.between(first, last) & closed.between(first, last)
    both = opened.isNotNull() & closed.isNotNull()
    anchored = F.coalesce(F.col("ledger").isNotNull() & both & covered & (opened < closed), F.lit(False))

    # Three stores: a bounded side to broadcast.
    spans = F.broadcast(stores.where(anchored).select("ledger", "opening_date", "closing_date"))
    moved = (
        cube.join(spans, "ledger")
        .where((F.col("day") >= opened) & (F.col("day") < closed))
        .groupBy("ledger")
        .agg(exact_total(cube_net("units")).alias("net"))
    )
    net = F.when(anchored, F.coalesce("net", F.lit(0.0)))
    expected = F.col("opening_qty") + net
    variance = F.col("closing_qty") - expected
    tolerance = F.greatest(F.lit(1.0), F.abs("closing_qty") * F.lit(TOLERANCE_PERCENT) / 100)
    reason = F.when(both & ~(opened < closed), SAME_BASELINE)
    if coverage is not None:
        reason = reason.otherwise(OUTSIDE_COVERAGE)
    no_ledger = F.col("ledger").isNull()
    return stores.join(moved, "ledger", "left").select(
        "dataset",
        F.col("label").alias("store"),
        "opening_date",
        "opening_qty",
        "closing_date",
        "closing_qty",
        F.when(no_ledger & both, F.col("closing_qty") - F.col("opening_qty")).alias("change"),
        net.alias("net_movement"),
        expected.alias("expected_closing"),
        variance.alias("variance"),
        F.when(anchored, tolerance).alias("tolerance"),
        F.when(no_ledger, "no ledger")
        .when(~anchored, "can't reconcile")
        .when(F.abs(variance) <= tolerance, "reconciles")
        .otherwise("off")
        .alias("verdict"),
        F.when(~no_ledger & ~anchored, reason).alias("reason"),
    )
