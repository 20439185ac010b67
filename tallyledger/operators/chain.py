"""Reconciliation over a chain of snapshots, and what kind of variance each key shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..config import LedgerRules
from ..functions.cells import non_blank
from ..functions.numbers import exact_total
from ..functions.vocabulary import KEY
from .movements import is_excluded, signed_quantity
from .reconcile import balance_legs, leg


def snapshot_cuts(snapshots: DataFrame) -> DataFrame:
    """One row per snapshot: when it was taken and its position in the chain (0 = oldest); fewer than two are an error.

    Snapshots are told apart by `snapshot_date`; each was taken at its newest `balance_date`.
    """
    taken = snapshots.groupBy("snapshot_date").agg(F.max("balance_date").alias("taken"))
    chain = taken.agg(F.sort_array(F.collect_list(F.struct("taken", "snapshot_date"))).alias("chain"))
    short = F.raise_error(F.lit("a chain needs at least two snapshots")).cast(chain.schema["chain"].dataType)
    chain = chain.select(F.when(F.size("chain") < 2, short).otherwise(F.col("chain")).alias("chain"))
    return chain.select(F.size("chain").alias("snapshots"), F.posexplode("chain").alias("position", "cut")).select(
        "position",
        "snapshots",
        "cut.snapshot_date",
        F.coalesce(
            "cut.taken",
            F.raise_error(F.lit("a snapshot of the chain has no balance_date")).cast("timestamp_ntz"),
        ).alias("taken"),
    )


def interval_calendar(cuts: DataFrame) -> DataFrame:
    """Which interval a day belongs to: one row per day from the first cut to the last.

    `passed` counts the cuts before the day, `today` lists the cuts on it, so that a movement finds
    its interval with one hash lookup on its day however many snapshots there are. The number of
    rows is the number of days the chain spans.
    """
    moments = cuts.agg(F.sort_array(F.collect_list("taken")).alias("moments"))
    days = F.sequence(F.to_date(F.array_min("moments")), F.to_date(F.array_max("moments")))
    return moments.select("moments", F.explode(days).alias("day")).select(
        "day",
        F.size(F.filter("moments", lambda cut: F.to_date(cut) < F.col("day"))).alias("passed"),
        F.filter("moments", lambda cut: F.to_date(cut) == F.col("day")).alias("today"),
        F.size("moments").alias("snapshots"),
    )


def with_interval(movements: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add `interval`: i for a movement at or after cut i-1 and before cut i; others are dropped.

    First and last cut reach the scan as a range on the raw date.
    """
    first = cuts.select(F.min("taken")).scalar()
    last = cuts.select(F.max("taken")).scalar()
    inside = movements.where((F.col("movement_date") >= first) & (F.col("movement_date") < last))
    on_day = F.size(F.filter("today", lambda cut: cut <= F.col("movement_date")))
    return (
        inside.withColumn("day", F.to_date("movement_date"))
        .join(F.broadcast(interval_calendar(cuts)), "day")  # bounded: one row per calendar day
        .withColumn("interval", F.col("passed") + on_day)
        .where((F.col("interval") >= 1) & (F.col("interval") < F.col("snapshots")))
        .drop("day", "passed", "today", "snapshots")
    )


def reconcile_chain(movements: DataFrame, snapshots: DataFrame, rules: LedgerRules) -> DataFrame:
    """Variance per item, warehouse and interval between consecutive snapshots, in one plan.

    `snapshots` holds the lots or totals of all snapshots with their `snapshot_date`. Snapshot i
    closes interval i and opens interval i + 1. Excluded movements do not count.
    """
    cuts = snapshot_cuts(snapshots)
    moved = with_interval(movements.where(~is_excluded(rules)), cuts)
    legs = [
        _snapshot_ends(snapshots, cuts),
        leg(signed_quantity(moved, rules), "net_movement", F.col("signed_qty"), "interval"),
    ]
    ends = F.broadcast(interval_labels(cuts))  # one row per interval
    return balance_legs(legs, rules, "interval").join(ends, "interval").select(
        *KEY, "interval", "period", *_CHAIN_AMOUNTS, "within_tolerance", "item_description"
    )


_CHAIN_AMOUNTS = ("opening_qty", "net_movement", "closing_qty", "expected_closing", "variance")


def _snapshot_ends(snapshots: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each snapshot row once as the closing of its interval and once as the opening of the next."""
    placed = snapshots.join(F.broadcast(cuts.drop("taken")), "snapshot_date")  # one row per snapshot
    opening = leg(placed, "opening_qty", F.col("quantity"), "position", "snapshots")
    return (
        opening.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
        .withColumn("interval", F.col("position") + F.col("step"))
        .where((F.col("interval") >= 1) & (F.col("interval") < F.col("snapshots")))
        .select(
            *KEY,
            "interval",
            "item_description",
            (F.lit(1) - F.col("step")).alias("source"),
            (F.col("opening_qty") * F.col("step")).alias("opening_qty"),
            "net_movement",
            (F.col("opening_qty") * (F.lit(1) - F.col("step"))).alias("closing_qty"),
        )
    )


def interval_labels(cuts: DataFrame) -> DataFrame:
    """Label 'yyyyMMdd->yyyyMMdd' of every interval."""
    moments = cuts.agg(F.sort_array(F.collect_list("taken")).alias("moments"))
    stamps = moments.select(F.transform("moments", lambda cut: F.date_format(cut, "yyyyMMdd")).alias("stamps"))
    return (
        stamps.select(F.posexplode("stamps").alias("interval", "closed"), "stamps")
        .where("interval >= 1")
        .select("interval", F.concat(F.get("stamps", F.col("interval") - 1), F.lit("->"), "closed").alias("period"))
    )


def chain_classify(
    periods: DataFrame,
    tolerance: float = 0.5,
    labels: Sequence[str] = (),
    ordered: bool = False,
) -> DataFrame:
    """Tell real variance from timing noise per item and warehouse.

    clean: never beyond tolerance in total; timing: moved but cancels out; persistent: nearly all
    of it survives to the end; mixed: part of it does. With `labels` the variance of each named
    period becomes a column.
    """
    variance = F.col("variance")
    per_period = [
        exact_total(variance, F.col("period") == label).alias(label) for label in labels
    ]
    totals = periods.groupBy(*KEY).agg(
        F.coalesce(F.min(non_blank(F.col("item_description"))), F.lit("")).alias("item_description"),
        exact_total(F.abs(variance)).alias("gross_variance"),
        exact_total(variance).alias("net_variance"),
        F.count_if(F.abs(variance) > tolerance).alias("periods_flagged"),
        *per_period,
    )
    gross, net = F.col("gross_variance"), F.abs("net_variance")
    kind = (
        F.when(gross <= tolerance, "clean")
        .when(net <= tolerance, "timing")
        .when(net >= gross - tolerance, "persistent")
        .otherwise("mixed")
    )
    result = totals.select(
        *KEY,
        "item_description",
        "gross_variance",
        "net_variance",
        "periods_flagged",
        kind.alias("classification"),
        *[f"`{label}`" for label in labels],
    )
    if not ordered:
        return result
    place = F.array_position(F.array(*map(F.lit, _CLASS_ORDER)), F.col("classification"))
    return result.orderBy(place, F.abs("net_variance").desc(), *KEY)


_CLASS_ORDER = ("persistent", "mixed", "timing", "clean")


def chain_wide(periods: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per item and warehouse with the variance of each named period, 0 where it has none."""
    return periods.groupBy(*KEY).pivot("period", list(labels)).agg(F.sum("variance")).na.fill(0.0)


def chain_class_counts(classified: DataFrame) -> DataFrame:
    """Keys and net variance per class."""
    return classified.groupBy("classification").agg(
        F.count(F.lit(1)).alias("items"), exact_total(F.col("net_variance")).alias("net_variance")
    )


def chain_period_stats(periods: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Per period: rows, and rows beyond tolerance."""
    return periods.groupBy("period").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.abs("variance") > tolerance).alias("variance_rows")
    )


def chain_report(classified: DataFrame) -> DataFrame:
    """What a reader needs to see: everything that is not clean."""
    return classified.where(F.col("classification") != "clean")
