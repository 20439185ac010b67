"""Totals of amounts of any size, against exact fractions."""

import math
import random
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from tallyledger.functions.numbers import exact_sum, exact_total, part_sums, total_of_parts

from .conftest import one

QUIET = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(scope="module")
def totals(spark):
    """Sum of several lists, one key each, by one aggregate, in two steps, and in another order."""

    def of(lists, parts=3):
        rows = [(k, i % 3, x) for k, values in enumerate(lists) for i, x in enumerate(values)]
        df = spark.createDataFrame(rows, "k int, half int, v double")
        once = {r.k: r.s for r in df.repartition(parts).groupBy("k").agg(exact_sum(F.col("v")).alias("s")).collect()}
        steps = df.groupBy("k", "half").agg(*part_sums("v")).groupBy("k").agg(total_of_parts("v").alias("s"))
        again = {r.k: r.s for r in steps.collect()}
        return [once.get(k) for k in range(len(lists))], [again.get(k) for k in range(len(lists))]

    return of


def close(found, values):
    """Right to the last bits of the exact sum; of digits below a millionth only as far as doubles tell them."""
    exact = sum(map(Fraction, values), Fraction(0))
    assert abs(Fraction(found) - exact) <= abs(exact) * Fraction(1, 2**51) + len(values) * Fraction(max(map(abs, values))) / 2**100 + Fraction(1, 10**12)


GIVEN = [
    [1e19],
    [4e18, 4e18, 4e18],
    [1e30, -1e30, 1.0],
    [1e30, 1.0, -1e30, 1e20, -1e20, 0.25],
    [2.0**48, -(2.0**48) + 1],
    [2.0**96, 2.0**72, -(2.0**96), -(2.0**72), 2.0**47, 3.5],
    [9.2e18] * 40,
    [-9.2e18] * 40,
    [1e35] * 500,
    [3.4e38, -3.4e38, 7.0],
    [1.7e308, -1.7e308, 0.5],
    [0.1] * 10 + [1e10, -1e10, 123456789.01],
    [12345678901234567890.0, -0.01],
    [5e-324],
    [-1e-7] * 9 + [1e15],
    [-5.0, -0.5, -1e6],
]


def test_given_sums(totals):
    once, steps = totals(GIVEN)
    for values, a, b in zip(GIVEN, once, steps, strict=True):
        close(a, values)
        assert a == b
    assert once[0] == 1e19 and once[1] == 1.2e19 and once[2] == 1.0 and once[4] == 1.0 and once[9] == 7.0 and once[10] == 0.5


def test_a_million_small_amounts(spark):
    tiny = spark.range(1_000_000).select(F.lit(4e-7).alias("v"))
    assert one(tiny.agg(exact_sum(F.col("v")).alias("s"))).s == pytest.approx(0.4, rel=1e-10)
    large = spark.range(1_000_000).select((F.lit(9e18) * F.when(F.col("id") % 2 == 0, 1).otherwise(-1) + F.lit(1024.0)).alias("v"))
    assert one(large.agg(exact_sum(F.col("v")).alias("s"))).s == 1_000_000 * 1024.0


@QUIET
@given(st.lists(st.lists(st.floats(-1e31, 1e31) | st.integers(-(2**62), 2**62).map(float) | st.floats(-1e6, 1e6).map(lambda x: round(x, 2)), min_size=1, max_size=12), min_size=1, max_size=12))
def test_against_fractions(totals, lists):
    once, steps = totals(lists)
    for values, a, b in zip(lists, once, steps, strict=True):
        if max(map(abs, values)) < 2.0**105:
            close(a, values)
        assert a == pytest.approx(b, rel=1e-12)


def test_the_order_does_not_matter(totals):
    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * rng.uniform(1, 10) * 10.0 ** rng.randint(-4, 28) for _ in range(400)]
    shuffled = [rng.sample(values, len(values)) for _ in range(5)]
    once, steps = totals(shuffled)
    assert len({*once, *steps}) == 1
    close(once[0], values)


def test_nulls_and_no_numbers(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (2, None), (3, math.nan), (4, math.inf), (4, 1.0), (5, 1e300), (5, None)], "k int, v double")
    got = {r.k: (r.s, r.t) for r in df.groupBy("k").agg(exact_sum(F.col("v")).alias("s"), exact_total(F.col("v"), F.col("k") != 2).alias("t")).collect()}
    assert got[1] == (None, 0.0) and got[2] == (3.0, 0.0) and got[4] == (math.inf, math.inf) and got[5] == (1e300, 1e300)
    assert math.isnan(got[3][0])
    assert one(df.where("k > 9").agg(exact_sum(F.col("v")).alias("s"), exact_total(F.col("v")).alias("t"))).asDict() == {"s": None, "t": 0.0}
    whole = spark.createDataFrame([(2**40,), (3,)], "v bigint")
    assert one(whole.agg(exact_sum(F.col("v")).alias("s"))).s == 2.0**40 + 3


def test_one_hash_aggregate(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    plan = df.groupBy("k").agg(exact_total(F.col("v")).alias("s"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan and "ObjectHash" not in plan
