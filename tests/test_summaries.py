import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from tallyledger.operators import balances, movements, summaries

from .conftest import day, one


KINDS = {"GRN": "receipt", "PRODUCTION_IN": "receipt", "ISSUE": "issue", "SALES_DISPATCH": "issue", "STOCK_ADJ": "adjustment", "MOVE": "other"}


@pytest.fixture(scope="module")
def drawn():
    """Random rows as conftest.moves takes them, over three months."""
    draw = random.Random(11)
    return [
        (draw.choice("PQR"), draw.choice(("north", "south")), f"2025-{draw.randint(1, 3):02d}-{draw.randint(1, 28):02d}", draw.choice([*KINDS]), draw.randint(-40, 90), f"n{k}")
        for k in range(300)
    ]


def test_every_direction_adds_up_per_item_store_and_month(moves, rules, drawn):
    want = {}
    for item, store, date, kind, quantity, _ in drawn:
        side = KINDS[kind]
        sums = want.setdefault((item, store, day(date[:8] + "01")), dict.fromkeys(("receipt", "issue", "adjustment", "other"), 0))
        sums[side] += -abs(quantity) if side == "issue" else quantity
    got = summaries.movement_summary(moves(drawn), rules).collect()
    assert {(r.item_code, r.warehouse, r.period): {side: r[side] for side in (*want[r.item_code, r.warehouse, r.period],)} for r in got} == want
    assert all(r.net == r.receipt + r.issue + r.adjustment + r.other for r in got)


def test_periods_start_on_monday_and_unknown_means_month(moves, rules):
    rows = moves([("A", "W", "2026-07-05 23:59:59", "GRN", 1, "")])  # a Sunday
    periods = {freq: one(summaries.movement_summary(rows, rules, freq)).period for freq in ("W", "D", "MS", "Q")}
    assert periods == {
        "W": day("2026-06-29"), "D": day("2026-07-05"), "MS": day("2026-07-01"), "Q": day("2026-07-01"),
    }


def test_buckets_of_the_rules_show_and_stay_out_of_net(moves, rules):
    rows = moves([("K", "S", "2025-02-03", "GRN", 21, ""), ("K", "S", "2025-02-04", "BREAKAGE", -8, "")])
    assert "breakage" not in summaries.movement_summary(rows, rules).columns
    assert one(summaries.movement_summary(rows, rules, extra_directions=["breakage"])).breakage == 0
    own = dataclasses.replace(rules, movement_types=rules.movement_types | {"breakages": ["BREAKAGE"]})
    row = one(summaries.movement_summary(rows, own))
    assert (row.breakage, row.other, row.net) == (-8, 0, 21)


def test_later_bucket_wins_and_unknown_types_are_other(moves, rules):
    rules = dataclasses.replace(rules, movement_types={"receipts": ["x"], "issues": ["X"], "empties": []})
    rows = moves([("A", "W", "2026-07-01", "X", 1, ""), ("B", "W", "2026-07-01", "Y", 1, "")])
    found = {r.item_code: r.direction for r in movements.classify_direction(rows, rules).collect()}
    assert found == {"A": "issue", "B": "other"}


def test_categories_count_add_up_and_sort_by_size_of_net(spark, rules, drawn):
    rules = dataclasses.replace(rules, issues_stored_positive=False)
    names = (" felt", "felt", "cord", "", None)
    rows = [(*row[:2], day(row[2]), row[3], float(row[4]), names[k % 5], k / 8) for k, row in enumerate(drawn)]
    table = spark.createDataFrame(
        rows, "item_code string, warehouse string, movement_date timestamp_ntz, movement_type string, quantity double, category string, value double"
    )
    want = {}
    for k, row in enumerate(drawn):
        label = (names[k % 5] or "").strip() or "(unspecified)"
        count, net, value = want.get(label, (0, 0, 0))
        want[label] = (count + 1, net + row[4], value + k / 8)
    got = summaries.category_summary(table, rules).collect()
    assert {r.category: (r.movements, r.net, r.net_value) for r in got} == want
    assert [abs(r.net) for r in got] == sorted((abs(r.net) for r in got), reverse=True)


def test_category_summary_requires_column(moves, rules):
    with pytest.raises(KeyError, match="category"):
        summaries.category_summary(moves([("any", "S", "2025-01-01", "MOVE", 3, "")]), rules)


def test_a_rule_excludes_what_meets_all_its_conditions(moves, rules, drawn):
    own = dataclasses.replace(
        rules,
        reconcile_exclusions=({"movement_type": "grn", "warehouse": "south"}, {"movement_type": "MOVE", "reference_prefix": "n1"}),
    )

    def hit(row):
        return row[3] == "GRN" and row[1] == "south" or row[3] == "MOVE" and row[5].startswith("n1")

    kept, excluded = movements.apply_exclusions(moves(drawn), own)
    assert {r.reference for r in excluded.collect()} == {row[5] for row in drawn if hit(row)}
    assert {r.reference for r in kept.collect()} == {row[5] for row in drawn if not hit(row)}
    totals = {r.excluded: (r.movements, r.quantity) for r in movements.exclusion_totals(moves(drawn), own).collect()}
    assert totals == {side: (sum(hit(r) == side for r in drawn), sum(r[4] for r in drawn if hit(r) == side)) for side in (True, False)}


def test_no_rules_keep_everything(moves, rules):
    kept, excluded = movements.apply_exclusions(moves([("A", "W", "2026-07-01", "RECEIVED", 5, "X")]), rules)
    assert (kept.count(), excluded.count()) == (1, 0)


def test_drilldown_is_sorted_and_keeps_known_columns(moves):
    rows = moves([("B", "W", "2026-07-02", "GRN", 2, ""), ("A", "W", "2026-07-01", "GRN", -5, "")])
    out = movements.movement_drilldown(rows)
    assert out.columns == [
        "movement_date", "item_code", "warehouse", "movement_type", "quantity", "reference", "item_description",
    ]
    assert [r.item_code for r in out.collect()] == ["A", "B"]
    totals = one(movements.drilldown_totals(rows))
    assert (totals.net_quantity, totals.movements) == (-3, 2)


def test_movement_types(moves):
    rows = moves([("A", "W", "2026-07-01", "GRN", 2, ""), ("A", "W", "2026-07-01", "GRN", 7, ""), ("A", "W", "2026-07-01", "ISSUE", -1, "")])
    out = summaries.movement_types(rows).collect()
    assert [(r.movement_type, r.rows, r.total_units, r.min_qty, r.max_qty) for r in out] == [
        ("GRN", 2, 9, 2, 7), ("ISSUE", 1, -1, -1, -1),
    ]


def test_empty_ledger_gives_empty_results_with_schema(moves, rules):
    empty = moves([])
    assert summaries.movement_summary(empty, rules).count() == 0
    assert summaries.movement_net(empty, rules).columns == ["item_code", "warehouse", "net_movement"]


def test_snapshot_asof_takes_each_keys_own_latest_date(held):
    rows = held(
        [
            ("A", "W", "2026-06-01", 5),
            ("A", "W", "2026-06-10", 7),
            ("A", "W", "2026-06-10", 1),
            ("B", "W", "2026-06-01", 3),
            ("B", "W", "2026-07-01", 9),
        ]
    )
    out = {r.item_code: (r.quantity, r.balance_date) for r in balances.snapshot_asof(rows, "2026-06-30").collect()}
    assert out == {"A": (8, day("2026-06-10")), "B": (3, day("2026-06-01"))}


def test_snapshot_current_adds_lots_and_skips_blank_text(spark, held):
    rows = held([("A", "W", "2026-06-01", 5), ("A", "W", "2026-06-03", 7)]).withColumn(
        "item_description", F.when(F.col("quantity") == 5, "").otherwise("Navy")
    ).withColumn("value", F.lit(0.1))
    row = one(balances.snapshot_current(rows))
    assert (row.quantity, row.balance_date, row.item_description, row.value) == (12, day("2026-06-03"), "Navy", 0.2)
