"""As-of joins against brute force, also where one key holds nearly all rows of both sides."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from tallyledger.operators.asof import asof_join

START = dt.datetime(2020, 1, 1)


def brute(requests, states):
    out = []
    for number, key, time in requests:
        known = [(t, (v is not None, v or 0), w) for k, t, v, w in states if key is not None and time is not None and k == key and t is not None and t <= time]
        best = max(known, default=None)
        value = (best[1][1] if best[1][0] else None, best[2]) if best else (None, None)
        out.append((number, key, time, *value))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    time = lambda: rng.choice([None, START + dt.timedelta(days=rng.randint(0, 800), hours=rng.choice([0, 0, 7]))])
    states = [(key(), time(), rng.choice([None, 1.5, 2.5]), f"w{i}") for i in range(150)] + [("z", START, 9.0, "z")]
    requests = [(i, key(), time()) for i in range(300)] + [(7, "a", START + dt.timedelta(days=400))] * 3 + [(999, "nowhere", START)]
    return requests, states


@pytest.mark.parametrize("bucket", ["day", "week", "month", "year"])
def test_against_brute_force(spark, sides, bucket):
    requests, states = sides
    left = spark.createDataFrame(requests, "number int, key string, time timestamp_ntz").repartition(5)
    right = spark.createDataFrame(states, "item string, since timestamp_ntz, value double, word string").withColumnRenamed("item", "key")
    got = asof_join(left, right, ["key"], "time", "since", ["value", "word"], bucket)
    assert got.columns == ["number", "key", "time", "value", "word"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(requests, states)


def test_empty_sides_and_clashing_names(spark):
    left = spark.createDataFrame([(1, "a", START)], "number int, key string, time timestamp_ntz")
    right = spark.createDataFrame([("a", START, 1.0)], "key string, since timestamp_ntz, value double")
    assert asof_join(left.where("false"), right, ["key"], "time", "since", ["value"]).count() == 0
    assert [r.value for r in asof_join(left, right.where("false"), ["key"], "time", "since", ["value"]).collect()] == [None]
    with pytest.raises(ValueError, match="requests have too"):
        asof_join(left, right.withColumn("number", F.lit(1)), ["key"], "time", "since", ["number"])


def test_one_key_with_many_rows_on_both_sides(spark):
    """100,000 states of one key and a million requests, merged without an array or a broadcast."""
    second = lambda column: (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=column))
    states = spark.range(100_000).select(F.lit("hot").alias("key"), second(F.col("id") * 1009).alias("since"), F.col("id").alias("state"))
    requests = spark.range(1_000_000).select(F.lit("hot").alias("key"), (F.col("id") * 101 + 50).alias("at")).withColumn("time", second(F.col("at")))
    joined = asof_join(requests, states, ["key"], "time", "since", ["state"])
    wrong = joined.where(~F.col("state").eqNullSafe(F.least(F.floor(F.col("at") / 1009), F.lit(99_999))))
    counts = joined.agg(F.count(F.lit(1)).alias("n"), F.count("state").alias("found")).first()
    assert wrong.count() == 0 and tuple(counts) == (1_000_000, 1_000_000)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan and "Broadcast" not in plan and "Join" not in plan
