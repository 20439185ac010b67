"""As-of join of two large sides: for each row of one the newest row of the other at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def asof_join(
    requests: DataFrame,
    states: DataFrame,
    on: Sequence[str],
    request_time: str,
    state_time: str,
    carried: Sequence[str],
    bucket: str = "month",
) -> DataFrame:
    """Every request with the carried columns of the newest state of its key at or before its time, else nulls.

    Both sides are laid on one time line, in a window per key and bucket of time (day, week, month, quarter or year), so that a key of
    any size spreads over its buckets; what is in force where a bucket begins is one row, found from the last states of
    the buckets before. No array, no broadcast and no range join: only rows of one key and bucket meet.

    Of several states of one time the one whose carried columns are greatest counts. A request without a time or with a
    null in its key gets nulls; repeated requests stay. Carried names must not be columns of the requests.
    """
    clash = set(carried) & set(requests.columns)
    if clash:
        raise ValueError(f"carried columns that the requests have too: {sorted(clash)}")
    keys = [f"_k{i}" for i in range(len(on))]

    def line(df: DataFrame, time: str, order: int):
        moment = df[time].cast("timestamp_ntz")
        named = [df[name].alias(key) for name, key in zip(on, keys, strict=True)]
        start = F.trunc(F.to_date(moment), bucket) if bucket != "day" else F.to_date(moment)  # free of the session zone
        return [*named, start.alias("_bucket"), moment.alias("_time"), F.lit(order).alias("_order")]

    state, request = F.struct(*[states[name] for name in carried]), F.struct(*[requests[name] for name in requests.columns])
    none = lambda df, column: F.lit(None).cast(df.select(column).schema[0].dataType)
    known = states.select(*line(states, state_time, 1), state.alias("_state")).where("_time IS NOT NULL")
    asked = requests.select(*line(requests, request_time, 2), none(states, state).alias("_state"), request.alias("_request"))
    # The last state of each bucket, and with it what was in force where the next bucket begins; combined before any sort.
    newest = F.max(F.when(F.col("_state").isNotNull(), F.struct("_time", "_state")))
    buckets = known.unionByName(asked.drop("_request")).groupBy(*keys, "_bucket").agg(newest.alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = buckets.select(
        *keys,
        "_bucket",
        F.lit(None).cast("timestamp_ntz").alias("_time"),
        F.lit(0).alias("_order"),
        F.last("_last", ignorenulls=True).over(before)["_state"].alias("_state"),
    )
    rows = known.unionByName(heads).withColumn("_request", none(requests, request)).unionByName(asked)
    until = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(F.asc_nulls_first("_time"), "_order", F.asc_nulls_first("_state"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    in_force = F.last("_state", ignorenulls=True).over(until)
    usable = F.col("_time").isNotNull()
    for key in keys:
        usable &= F.col(key).isNotNull()
    found = rows.withColumn("_found", F.when(usable, in_force)).where("_order = 2")
    return found.select("_request.*", *[F.col("_found")[name].alias(name) for name in carried])
