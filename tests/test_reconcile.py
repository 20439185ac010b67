import dataclasses

import pytest
from pyspark.sql import functions as F

from tallyledger.operators import chain, reconcile

from .conftest import one


@pytest.mark.parametrize(("closing", "gap", "fine"), [(31, 0, True), (31.5, 0.5, True), (30.25, -0.75, False), (40, 9, False)])
def test_variance_against_the_tolerance(held, moves, rules, closing, gap, fine):
    moved = moves([("bolt", "shed", "2025-04-02", "GRN", 25, ""), ("bolt", "shed", "2025-04-03", "ISSUE", 11, "")])
    opening, now = (held([("bolt", "shed", date, q)]) for date, q in (("2025-04-01", 17), ("2025-05-01", closing)))
    row = one(reconcile.reconcile(opening, moved, now, rules))
    assert (row.expected_closing, row.variance, row.within_tolerance) == (31, gap, fine)


def test_every_leg_can_stand_alone(held, moves, rules):
    out = reconcile.reconcile(
        held([("O", "W", "2026-06-01", 1)]),
        moves([("M", "W", "2026-06-05", "ISSUE", 2, "")]),
        held([("C", "W", "2026-07-01", 3)]),
        rules,
        ordered=True,
    ).collect()
    assert [(r.item_code, r.variance) for r in out] == [("C", 3), ("M", 2), ("O", -1)]


def test_description_comes_from_the_first_leg_that_has_one(held, moves, rules):
    def described(df, text):
        return df.withColumn("item_description", F.lit(text))

    opening = described(held([("A", "W1", "2026-06-01", 1)]), "")
    closing = described(held([("A", "W2", "2026-07-01", 1)]), "from closing")
    moved = described(moves([("A", "W3", "2026-06-05", "GRN", 1, "")]), "a movement")
    out = reconcile.reconcile(opening, moved, closing, rules).collect()
    assert {r.item_description for r in out} == {"from closing"} and len(out) == 3
    assert one(reconcile.item_description_lookup(opening, closing, moved)).item_description == "from closing"


def test_window_runs_from_snapshot_to_snapshot(held, moves, rules):
    opening = held([("A", "W", "2026-06-01", 10), ("B", "W", "2026-06-02", 0)])
    closing = held([("A", "W", "2026-06-10", 15)])
    rows = moves(
        [
            ("A", "W", "2026-06-01", "GRN", 100, "before"),
            ("A", "W", "2026-06-02", "GRN", 5, "at the start"),
            ("A", "W", "2026-06-10", "GRN", 100, "at the end"),
        ]
    )
    out = {r.item_code: r for r in reconcile.reconcile_snapshots(opening, rows, closing, rules).collect()}
    assert (out["A"].net_movement, out["A"].variance) == (5, 0)
    wider = reconcile.reconcile_snapshots(opening, rows, closing, rules, date_from="2026-06-01", date_to="2026-06-11")
    assert {r.item_code: r.net_movement for r in wider.collect()}["A"] == 205
    live = reconcile.reconcile_snapshots(opening, rows, closing, rules, live=True, now="2026-06-10 00:00:01")
    assert {r.item_code: r.net_movement for r in live.collect()}["A"] == 105


def test_undated_snapshot_is_an_error(held, moves, rules):
    undated = held([("A", "W", "2026-06-01", 10)]).withColumn("balance_date", F.lit(None).cast("timestamp_ntz"))
    rows = moves([("A", "W", "2026-06-01", "GRN", 1, "")])
    with pytest.raises(Exception, match="opening snapshot has no balance_date"):
        reconcile.reconcile_snapshots(undated, rows, held([("A", "W", "2026-06-10", 15)]), rules).collect()
    with pytest.raises(ValueError, match="needs date_to or now"):
        reconcile.reconcile_snapshots(undated, rows, undated, rules, live=True)


def test_dated_balances(held, moves, rules):
    balances = held([("A", "W", "2026-06-01", 10), ("A", "W", "2026-06-20", 25), ("A", "W", "2026-07-01", 99)])
    rows = moves([("A", "W", "2026-06-05", "GRN", 14, "")])
    row = one(reconcile.reconcile_dated(balances, rows, rules, "2026-06-02", "2026-07-01"))
    assert (row.opening_qty, row.closing_qty, row.variance) == (10, 25, 1)


PERIODS = "item_code string, warehouse string, period string, variance double, item_description string"


def test_every_class_by_its_own_pattern(spark):
    patterns = {"persistent": (12.0, 7.0, 3.0), "timing": (45.0, 0.0, -45.0), "mixed": (90.0, -20.0, 0.0), "clean": (0.25, -0.125, 0.0)}
    labels = ["a", "b", "c"]
    rows = spark.createDataFrame([(f"item {name}", "shed", label, gap, name) for name, gaps in patterns.items() for label, gap in zip(labels, gaps, strict=True)], PERIODS)
    classed = chain.chain_classify(rows, 0.5, labels=labels)
    out = {r.classification: r for r in classed.collect()}
    assert {name: r.item_code for name, r in out.items()} == {name: f"item {name}" for name in patterns}
    for name, gaps in patterns.items():
        row = out[name]
        assert (row.a, row.b, row.c) == gaps
        assert (row.net_variance, row.gross_variance) == (sum(gaps), sum(map(abs, gaps)))
        assert row.periods_flagged == sum(abs(gap) > 0.5 for gap in gaps)
    counts = {r.classification: (r["items"], r.net_variance) for r in chain.chain_class_counts(classed).collect()}
    assert counts == {name: (1, sum(gaps)) for name, gaps in patterns.items()}
    assert {r.classification for r in chain.chain_report(classed).collect()} == {"persistent", "timing", "mixed"}
    wide = {r.item_code: (r.a, r.b, r.c) for r in chain.chain_wide(rows, labels).collect()}
    assert wide == {f"item {name}": gaps for name, gaps in patterns.items()}
    stats = {r.period: (r.rows, r.variance_rows) for r in chain.chain_period_stats(rows).collect()}
    assert stats == {label: (4, sum(abs(gaps[k]) > 0.5 for gaps in patterns.values())) for k, label in enumerate(labels)}


@pytest.fixture
def captures(held):
    def build(rows):
        return held(rows).withColumn("snapshot_date", F.to_date("balance_date"))

    return build


def test_chain_is_half_open_and_equals_pairwise_reconciliation(captures, moves, rules):
    rules = dataclasses.replace(rules, reconcile_exclusions=({"reference_prefix": "SKIP"},))
    snaps = captures(
        [
            ("A", "W", "2026-06-01 06:00:00", 10),
            ("A", "W", "2026-06-08 06:00:00", 14),
            ("A", "W", "2026-07-01 06:00:00", 20),
            ("GONE", "W", "2026-06-01 06:00:00", 4),
            ("NEW", "W", "2026-07-01 06:00:00", 6),
        ]
    )
    rows = moves(
        [
            ("A", "W", "2026-06-01 05:59:59", "GRN", 1000, "too early"),
            ("A", "W", "2026-06-01 06:00:00", "GRN", 3, "first"),
            ("A", "W", "2026-06-08 05:59:59", "GRN", 1, "first"),
            ("A", "W", "2026-06-08 06:00:00", "GRN", 5, "second"),
            ("A", "W", "2026-06-20", "GRN", 50, "SKIP-1"),
            ("A", "W", "2026-07-01 06:00:00", "GRN", 1000, "too late"),
        ]
    )
    out = {(r.item_code, r.interval): r for r in chain.reconcile_chain(rows, snaps, rules).collect()}
    assert out["A", 1].period == "20260601->20260608" and out["A", 2].period == "20260608->20260701"
    assert (out["A", 1].net_movement, out["A", 1].variance) == (4, 0)
    assert (out["A", 2].net_movement, out["A", 2].variance) == (5, 1)
    assert out["GONE", 1].variance == -4 and ("GONE", 2) not in out
    assert out["NEW", 2].variance == 6 and ("NEW", 1) not in out
    for i, (start, end) in enumerate((("2026-06-01", "2026-06-08"), ("2026-06-08", "2026-07-01")), 1):
        pick = lambda d: snaps.where(F.col("snapshot_date") == F.lit(d).cast("date"))
        pair = reconcile.reconcile_snapshots(pick(start), rows, pick(end), rules).collect()
        assert {(r.item_code, r.variance) for r in pair} == {
            (item, r.variance) for (item, interval), r in out.items() if interval == i
        }


def test_chain_survives_two_captures_on_one_day(held, moves, rules):
    snaps = held(
        [("A", "W", "2026-06-01 06:00:00", 1), ("A", "W", "2026-06-01 18:00:00", 3), ("A", "W", "2026-06-02", 9)]
    ).withColumn("snapshot_date", F.col("balance_date").cast("string"))
    rows = moves([("A", "W", "2026-06-01 12:00:00", "GRN", 2, ""), ("A", "W", "2026-06-01 18:00:00", "GRN", 6, "")])
    out = {r.interval: r.variance for r in chain.reconcile_chain(rows, snaps, rules).collect()}
    assert out == {1: 0, 2: 0}


def test_undated_chain_is_an_error(captures, moves, rules):
    snaps = captures([("A", "W", "2026-06-01", 1), ("A", "W", "2026-06-02", 1)])
    snaps = snaps.withColumn("balance_date", F.when(F.col("snapshot_date") > "2026-06-01", F.col("balance_date")))
    with pytest.raises(Exception, match="no balance_date"):
        chain.reconcile_chain(moves([]), snaps, rules).collect()


def test_legs_are_dealt_into_the_partitions_of_the_session_with_one_set_of_sums(moves, held, rules):
    """A row of a leg brings one amount, and adaptive execution may not merge what is dealt out into a partition a core."""
    df = reconcile.reconcile(held([("A", "W", "2026-06-01", 5)]), moves([("A", "W", "2026-06-02", "GRN", 2, "")]), held([("A", "W", "2026-07-01", 8)]), rules)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "amount_3" in plan and "opening_qty_0" not in plan
    row = df.first()
    assert (row.opening_qty, row.net_movement, row.closing_qty, row.variance) == (5.0, 2.0, 8.0, 1.0)
