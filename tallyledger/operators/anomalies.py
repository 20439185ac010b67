"""Findings a stock controller should look at: negative balances, outliers, dormant items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import LedgerRules
from ..functions.numbers import plain_text
from ..functions.reuse import dealt, shared
from ..functions.vocabulary import KEY
from ..sources.canonical import Moment, at

# What findings need of balances: texts and values need not be added up for them.
BALANCE_COLUMNS = (*KEY, "balance_date", "quantity")
FINDING_COLUMNS = ("kind", "item_code", "warehouse", "detail", "value")

# Scale of a normal distribution from its median, and from its mean, absolute deviation.
MEDIAN_DEVIATION_SCALE = 1.4826
MEAN_DEVIATION_SCALE = 1.2533
MIN_MOVEMENTS = 5

# Distinct quantities that may meet on a key; keys with more are fewer than a row in _WIDE.
_WIDE = 65_536


def negative_balance(balances: DataFrame) -> DataFrame:
    """Keys whose latest balance is below zero; of several rows on that date the lowest counts."""
    dated = balances.groupBy(*KEY, "balance_date").agg(F.min("quantity").alias("quantity"))
    # A missing date is older than any.
    when = F.coalesce("balance_date", F.lit("0001-01-01").cast("timestamp_ntz"))
    latest = dated.groupBy(*KEY).agg(F.max("balance_date").alias("balance_date"), F.max_by("quantity", when).alias("quantity"))
    return latest.where(F.col("quantity") < 0)


# ---- exact medians per key ---------------------------------------------------------------------
# A frequency table (key, x, weight) stands for the rows: it is built by a plain count, so a key with a third
# of all rows combines before the shuffle, and a median needs only the weights of its distinct values. Those of a key with
# no more than _WIDE of them come together at once: sorted by value they give the median, sorted by distance the spread.
#
# A key with more is too much for one task. Its values lie in
# slices of their range, which spread over tasks. What meets on a key is one row per slice: sums, least and greatest
# value. From these follow the slices that the median can lie in, bounds of every slice's distance from it, and so
# the slices that the median of distances can lie in. Only their values come together, once, and give both.


def _at_or_before(position: Column, reached: Column, weight: Column) -> Column:
    """True for the value whose run of equal entries covers a 0-based position."""
    return (reached > position) & (reached - weight <= position)


def _middle(total: Column) -> tuple[Column, Column]:
    """0-based positions of the two middle entries (the same one for an odd number)."""
    return F.shiftright(total - 1, 1), F.shiftright(total, 1)


def _slice_of(x: Column) -> Column:
    """A coarse value that never decreases as x grows: about 1% of x wide at every magnitude, also below one."""
    # log2 of the smallest double is -1074; the shift keeps slices of small numbers next to that of zero.
    wide = F.floor((F.log2(F.abs(x)) + 1075) * 64) + 1
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * wide).cast("bigint")


def quantity_frequencies(movements: DataFrame) -> DataFrame:
    """(key, x, weight, last_move): how often each quantity occurs, and when it did last."""
    counted = movements.groupBy(*KEY, F.col("quantity").alias("x")).agg(
        F.count(F.lit(1)).alias("weight"), F.max("movement_date").alias("last_move")
    )
    return shared(counted)


def _values_per_key(movements: DataFrame) -> DataFrame:
    """(key, values): how many different quantities a key has."""
    return quantity_frequencies(movements).groupBy(*KEY).agg(F.count("x").alias("values"))


def _per_key(movements: DataFrame) -> DataFrame:
    """(key, movements, last_move): how often a key moved, and when it did last."""
    counted = movements.groupBy(*KEY)
    return shared(counted.agg(F.count(F.lit(1)).alias("movements"), F.max("movement_date").alias("last_move")))


def _narrow_and_wide(movements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, x, weight) of the keys with up to _WIDE quantities, and of those with more.

    The condition is on the weight: it can not move below the count, which so stays the same for every reader.
    """
    known = F.col("item_code").isNotNull() & F.col("warehouse").isNotNull() & F.col("x").isNotNull()
    counted = quantity_frequencies(movements).where(F.when(known, F.col("weight")) > 0).select(*KEY, "x", "weight")
    wide = F.broadcast(_values_per_key(movements).where(F.col("values") > _WIDE).select(*KEY))  # a key per _WIDE rows at most
    return counted.join(wide, list(KEY), "left_anti"), counted.join(wide, list(KEY), "left_semi")


def _sliced(counted: DataFrame) -> DataFrame:
    """(key, slice, x, weight), the rows of a slice in one task."""
    place = F.coalesce(_slice_of(F.col("x")), F.lit(0)).alias("slice")
    return dealt(counted.select(*KEY, place, "x", "weight"), *KEY, "slice")


# What a key's slices tell of the key: its rows, the weight that is nearer than any value looked at, the sums and weights
# beyond the middle on both sides, and its extreme values.
_OF_KEY = ("total", "nearer", "weight_above", "sum_above", "weight_below", "sum_below", "lowest", "highest")


def _wanted_slices(sliced: DataFrame, at_least: int) -> DataFrame:
    """(key, slice, before, middle, _OF_KEY): the slices that hold a median of the values or of their distances.

    Keys with fewer than at_least rows are left out.
    """
    whole = Window.partitionBy(*KEY)
    running = lambda *order: whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    low, high = _middle(F.col("total"))
    weight, reached = F.col("slice_weight"), F.col("reached")
    summed = sliced.groupBy(*KEY, "slice").agg(
        F.sum("weight").alias("slice_weight"),
        F.sum(F.col("x") * F.col("weight")).alias("slice_sum"),
        F.min("x").alias("least"),
        F.max("x").alias("greatest"),
    )
    placed = (
        summed.repartition(*KEY)
        .withColumn("total", F.sum("slice_weight").over(whole))
        .where(F.col("total") >= at_least)
        .withColumn("reached", F.sum("slice_weight").over(running("slice")))
    )

    def middle(name: str) -> Column:
        ends = [F.max(F.when(_at_or_before(place, reached, weight), F.col(name))).over(whole) for place in (low, high)]
        return (ends[0] + ends[1]) / 2

    # The median lies between from and to; with that, every value of a slice at a distance between near and far.
    around = placed.withColumns({"from": middle("least"), "to": middle("greatest")}).withColumns(
        {
            "near": F.greatest(F.lit(0.0), F.col("least") - F.col("to"), F.col("from") - F.col("greatest")),
            "far": F.greatest(F.col("greatest") - F.col("from"), F.col("to") - F.col("least")),
        }
    )
    at_most = around.withColumn("within_near", F.sum("slice_weight").over(running("near", "slice"))).withColumn(
        "within_far", F.sum("slice_weight").over(running("far", "slice"))
    )
    bounded = at_most.withColumns(
        {
            "first": F.min(F.when(F.col("within_near") > low, F.col("near"))).over(whole),
            "last": F.min(F.when(F.col("within_far") > high, F.col("far"))).over(whole),
        }
    )
    is_middle = (F.col("least") <= F.col("to")) & (F.col("greatest") >= F.col("from"))
    holds_middle = _at_or_before(low, reached, weight) | _at_or_before(high, reached, weight)
    wanted = bounded.withColumn("middle", is_middle | holds_middle).withColumn(
        "wanted", F.col("middle") | ((F.col("far") >= F.col("first")) & (F.col("near") <= F.col("last")))
    )
    above, below = ~F.col("middle") & (F.col("least") > F.col("to")), ~F.col("middle") & (F.col("greatest") < F.col("from"))

    def over_key(name: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(name))).over(whole), F.lit(0))

    of_key = wanted.withColumns(
        {
            "nearer": over_key("slice_weight", ~F.col("wanted") & (F.col("far") < F.col("first"))),
            "weight_above": over_key("slice_weight", above),
            "sum_above": over_key("slice_sum", above),
            "weight_below": over_key("slice_weight", below),
            "sum_below": over_key("slice_sum", below),
            "lowest": F.min("least").over(whole),
            "highest": F.max("greatest").over(whole),
        }
    )
    return of_key.where("wanted").select(*KEY, "slice", (reached - weight).alias("before"), "middle", *_OF_KEY)


def robust_spread(movements: DataFrame, at_least: int = 1) -> DataFrame:
    """(key, median, scale, count, lowest, highest) of every key with at_least movements, on raw quantities."""
    narrow, wide = _narrow_and_wide(movements)
    return _narrow_spread(narrow, at_least).unionByName(_wide_spread(wide, at_least))


def _narrow_spread(counted: DataFrame, at_least: int) -> DataFrame:
    """The spread of keys whose quantities fit a task, in one exchange and two sorts."""
    whole = Window.partitionBy(*KEY)
    weight, reached = F.col("weight"), F.col("reached")
    low, high = _middle(F.col("total"))

    def ends(x: str) -> list[Column]:
        return [F.max(F.when(_at_or_before(place, reached, weight), F.col(x))) for place in (low, high)]

    def running(order: str) -> Column:
        return F.sum("weight").over(whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))

    lower, upper = ends("x")
    placed = (
        dealt(counted, *KEY)
        .withColumn("reached", running("x"))
        .withColumn("total", F.sum("weight").over(whole))  # in the order that is there already
        .where(F.col("total") >= at_least)
        .withColumn("median", (lower.over(whole) + upper.over(whole)) / 2)
        .withColumn("distance", F.abs(F.col("x") - F.col("median")))
        .withColumn("reached", running("distance"))
    )
    nearest, next_nearest = ends("distance")
    return placed.groupBy(*KEY, "median").agg(
        _scale((nearest + next_nearest) / 2, F.sum(F.col("distance") * weight) / F.max("total")).alias("scale"),
        F.max("total").alias("count"),
        F.min("x").alias("lowest"),
        F.max("x").alias("highest"),
    )


def _wide_spread(counted: DataFrame, at_least: int) -> DataFrame:
    """The spread of keys whose quantities spread over tasks."""
    sliced = _sliced(counted)
    whole = Window.partitionBy(*KEY)
    weight, reached = F.col("weight"), F.col("reached")
    low, high = _middle(F.col("total"))
    within = Window.partitionBy(*KEY, "slice").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    outwards = whole.orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)

    def middle(x: str) -> tuple[Column, Column]:
        ends = [F.max(F.when(_at_or_before(place, reached, weight), F.col(x))) for place in (low, high)]
        return ends[0], ends[1]

    lower, upper = middle("x")
    placed = (
        sliced.join(_wanted_slices(sliced, at_least), [*KEY, "slice"])
        .withColumn("reached", F.col("before") + F.sum("weight").over(within))
        .repartition(*KEY)
        .withColumn("median", (lower.over(whole) + upper.over(whole)) / 2)
        .withColumn("distance", F.abs(F.col("x") - F.col("median")))
        .withColumn("reached", F.col("nearer") + F.sum("weight").over(outwards))
    )
    nearest, next_nearest = middle("distance")
    beyond = F.max("sum_above") - F.max("weight_above") * F.col("median")
    before = F.max("weight_below") * F.col("median") - F.max("sum_below")
    inside = F.sum(F.when(F.col("middle"), F.col("distance") * weight))
    return placed.groupBy(*KEY, "median").agg(
        _scale((nearest + next_nearest) / 2, (inside + beyond + before) / F.max("total")).alias("scale"),
        F.max("total").alias("count"),
        F.max("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
    )


def _scale(mad: Column, mean: Column) -> Column:
    return F.when(mad > 0, F.lit(MEDIAN_DEVIATION_SCALE) * mad).otherwise(F.lit(MEAN_DEVIATION_SCALE) * mean)


def robust_stats(movements: DataFrame) -> DataFrame:
    """Median, robust scale and number of movements per item and warehouse, on raw quantities."""
    return robust_spread(movements).select(*KEY, "median", "scale", "count")


def _beside_spread(movements: DataFrame) -> DataFrame:
    """Movements with the median and the scale of their key, all movements of a key in one task."""
    whole = Window.partitionBy(*KEY)
    # A movement without a quantity weighs nothing. A condition would be carried down to the source.
    weight, reached, distance = F.col("_weight"), F.col("_reached"), F.col("_distance")
    low, high = _middle(F.col("_total"))

    def middle(x: str) -> Column:
        ends = [F.max(F.when(_at_or_before(place, reached, weight), F.col(x))).over(whole) for place in (low, high)]
        return (ends[0] + ends[1]) / 2

    def running(order: str) -> Column:
        return F.sum("_weight").over(whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))

    placed = (
        dealt(movements, *KEY)
        .withColumn("_weight", F.when(F.col("quantity").isNotNull(), 1).otherwise(0))
        .withColumn("_reached", running("quantity"))
        .withColumn("_total", F.sum("_weight").over(whole))  # in the order that is there already
        .where(F.col("_total") >= MIN_MOVEMENTS)
        .withColumn("median", middle("quantity"))
        .withColumn("_distance", F.abs(F.col("quantity") - F.col("median")))
        .withColumn("_reached", running("_distance"))
    )
    mean = F.sum(distance * weight).over(whole) / F.col("_total")
    return placed.withColumn("scale", _scale(middle("_distance"), mean)).select(*movements.columns, "median", "scale")


def outlier_movements(movements: DataFrame, rules: LedgerRules) -> DataFrame:
    """Movements far from what is typical for their item and warehouse.

    Movements of a key with no more than _WIDE of them meet at once, and what is far is told there. Keys with more are few: their
    quantities are counted first, and movements join the typical one of their key. That join is on the key alone, with one row a key on
    the other side, so that Spark may split a key with many movements over tasks.
    """
    far = lambda x: F.abs(F.col(x) - F.col("median")) / F.col("scale") > rules.outlier_zscore
    named = movements.where(F.col("item_code").isNotNull() & F.col("warehouse").isNotNull())
    crowded = F.broadcast(_per_key(movements).where(F.col("movements") > _WIDE).select(*KEY))  # a key per _WIDE rows at most
    few, many = named.join(crowded, list(KEY), "left_anti"), named.join(crowded, list(KEY), "left_semi")
    suspected = (
        robust_spread(many, MIN_MOVEMENTS)
        .where(F.col("scale") > 0)
        .where(far("lowest") | far("highest"))
        .select(*KEY, "median", "scale")
    )
    # A row a key is hashed rather than that all movements are sorted. The condition tells nothing of the quantity alone: Spark
    # would carry that down to the source, whose exchanges then were not the same for few, many and their frequencies.
    is_far = F.coalesce((F.col("scale") > 0) & far("quantity"), F.lit(False))
    columns = (*KEY, *[name for name in movements.columns if name not in KEY], "median", "scale")
    frames = (_beside_spread(few), many.join(suspected.hint("shuffle_hash"), list(KEY)))
    return reduce(DataFrame.unionByName, [df.where(is_far).select(*columns) for df in frames])


def dormant_items(
    movements: DataFrame, rules: LedgerRules, as_of: Moment | None = None
) -> DataFrame:
    """Keys that moved, but not within the last `dormant_days` whole days before `as_of`.

    `as_of` defaults to the date of the newest movement.
    """
    moved = _per_key(movements)  # the exchange that tells crowded keys
    now = at(as_of) if as_of is not None else moved.select(F.max("last_move")).scalar()
    return (
        moved.select(*KEY, "last_move")
        .withColumn("as_of", now)
        .withColumn("idle_days", F.extract(F.lit("DAY"), F.col("as_of") - F.col("last_move")))
        .where(F.col("idle_days") > rules.dormant_days)
    )


def _day(moment: str) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def anomalies(
    movements: DataFrame,
    balances: DataFrame | None,
    rules: LedgerRules,
    as_of: Moment | None = None,
) -> DataFrame:
    """All findings, one row each: kind, item, warehouse, detail text and value."""
    findings = []
    if balances is not None:
        findings.append(
            negative_balance(balances).select(
                F.lit("negative_balance").alias("kind"),
                *KEY,
                F.concat(
                    F.lit("balance "), plain_text(F.col("quantity"), 1), F.lit(" on "), _day("balance_date")
                ).alias("detail"),
                F.col("quantity").alias("value"),
            )
        )
    findings.append(
        outlier_movements(movements, rules).select(
            F.lit("outlier_movement").alias("kind"),
            *KEY,
            F.concat(
                "movement_type",
                F.lit(" of "),
                plain_text(F.col("quantity"), 1),
                F.lit(" on "),
                _day("movement_date"),
                F.lit(" (ref "),
                "reference",
                F.lit("), typical "),
                plain_text(F.col("median"), 1),
                F.lit(" (robust spread "),
                plain_text(F.col("scale"), 1),
                F.lit(")"),
            ).alias("detail"),
            F.col("quantity").alias("value"),
        )
    )
    findings.append(
        dormant_items(movements, rules, as_of).select(
            F.lit("dormant_item").alias("kind"),
            *KEY,
            F.concat(
                F.lit("no movement since "),
                _day("last_move"),
                F.lit(" ("),
                F.col("idle_days").cast("string"),
                F.lit(" days as of "),
                _day("as_of"),
                F.lit(")"),
            ).alias("detail"),
            F.col("idle_days").cast("double").alias("value"),
        )
    )
    return reduce(DataFrame.unionByName, findings)
