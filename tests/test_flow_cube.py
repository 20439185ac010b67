import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyledger.functions.numbers import exact_sum, part_sums, plain_text, rounded, signed_text, total_of_parts
from tallyledger.operators import balances, cube, flow

from .conftest import day, one

LEDGER = (
    "dataset string, item_code string, warehouse string, movement_date timestamp_ntz, movement_type string, "
    "quantity double, value double, reference string"
)
PRODUCTION = "Production (DO/IC jobs)"


@pytest.fixture
def flow_rules(rules):
    """Signed quantities; the types that the routes below need."""
    sides = {"adjustments": ["STOCK ADJ OUT"], "issues": ["PICKED", "DESPATCH"], "receipts": ["RETURN", "RECEIVED", "RECEIPT"]}
    return dataclasses.replace(rules, movement_types=sides, issues_stored_positive=False)


def ledger(spark, rows):
    return spark.createDataFrame([(d, i, w, day(t), k, float(q), float(v), r) for d, i, w, t, k, q, v, r in rows], LEDGER)


ROUTES = [
    # ledger, type, sign of the quantity, from, to; {} is the store, once per kind of movement
    ("rm", "RECEIPT", 1, "Vendors", "RM · {}"),
    ("rm", "DESPATCH", -1, "RM · {}", PRODUCTION),
    ("fg", "RECEIVED", 1, PRODUCTION, "FG · {}"),
    ("fg", "PICKED", -1, "FG · {}", "Customers"),
    ("fg", "STOCK ADJ OUT", -1, "FG · {}", "Adj out (FG)"),
]


def test_each_route_leads_from_its_source_to_its_target(spark, flow_rules):
    rows, want = [], {}
    for n, (ledger_name, kind, sign, source, target) in enumerate(ROUTES, 1):
        for store in ("Attic", "Cellar"):
            units, money = 3 * n + len(store), 17.0 * n + len(store)
            for half in (0.25, 0.75):
                rows.append((f"{ledger_name}_movements", f"item{n}", store, f"2025-03-{n:02d}", kind, sign * units * half, sign * money * half, f"d{n}"))
            want[source.format(store), target.format(store)] = (money, units)
    quiet = ("fg_movements", "item9", "Attic", "2025-03-09", "TRANSFERRED IN", 6, 60.0, "")
    table = ledger(spark, [*rows, quiet])
    links = flow.flow_links(flow.flow_contributions(table, flow_rules))
    assert {(r.source, r.target): (r.weight, r.units) for r in links.collect()} == want
    seen = {r.movement_type: (r.rows, r.units, r.value) for r in flow.flow_components(table).collect()}
    assert seen["TRANSFERRED IN"] == (1, 6, 60) and seen["DESPATCH"][0] == 4
    nodes = {r.name: (r.role, r.column) for r in flow.flow_nodes(links).collect()}
    assert (nodes["Vendors"], nodes["FG · Cellar"], nodes["Adj out (FG)"]) == (("vendors", 0), ("fg_store", 3), ("hub", 4))
    totals = {r.name: (r.inward, r.outward, r.total) for r in flow.flow_node_totals(links).collect()}
    inward = sum(w for (_, t), (w, _) in want.items() if t == PRODUCTION)
    outward = sum(w for (f, _), (w, _) in want.items() if f == PRODUCTION)
    assert totals[PRODUCTION] == (inward, outward, max(inward, outward))


def test_what_comes_back_nets_against_what_went(spark, flow_rules):
    table = ledger(
        spark,
        [
            ("rm_movements", "cloth", "Attic", "2025-03-01", "DESPATCH", -31, -62.0, "d"),
            ("rm_movements", "cloth", "Attic", "2025-03-04", "RETURN", 12, 24.0, "d"),
        ],
    )
    row = one(flow.flow_links(flow.flow_contributions(table, flow_rules)))
    assert (row.source, row.target, row.weight, row.units) == ("RM · Attic", PRODUCTION, 38.0, 19.0)


def test_without_money_the_units_decide(spark, flow_rules):
    table = ledger(spark, [("rm_movements", "cloth", "Attic", "2025-03-01", "RECEIPT", q, 0.0, "") for q in (13, 28)])
    for given in (table, table.drop("value")):
        row = one(flow.flow_links(flow.flow_contributions(given, flow_rules)))
        assert (row.measure, row.weight, row.units) == ("units", 41, 41)
    with pytest.raises(ValueError, match="measure"):
        flow.flow_contributions(table, flow_rules, "pieces")


def test_value_of_an_unrouted_movement_still_decides_the_measure(spark, flow_rules):
    rows = ledger(
        spark,
        [
            ("rm_movements", "F1", "Fabric", "2026-07-01", "RECEIPT", 100, 0.0, ""),
            ("rm_movements", "F1", "Fabric", "2026-07-01", "TRANSFERRED IN", 1, 5.0, ""),
        ],
    )
    assert one(flow.flow_contributions(rows, flow_rules)).measure == "value"


def test_cancellations_and_opposing_edges(spark, flow_rules):
    rows = ledger(
        spark,
        [
            ("rm_movements", "F1", "S", "2026-07-01", "CANCELLED DESPATCH", 10, 10.0, ""),
            ("fg_movements", "F1", "S", "2026-07-01", "DESPATCH CANCELLED - REJECTED", -3, -3.0, ""),
            ("fg_movements", "F1", "S", "2026-07-01", "ASN", 0, 0.0, ""),
        ],
    )
    edges = {(r.source, r.target): r.weight for r in flow.flow_links(flow.flow_contributions(rows, flow_rules)).collect()}
    assert edges == {(PRODUCTION, "RM · S"): 10.0, ("FG · S", "Customers"): 3.0}
    both = spark.createDataFrame([("a", "b", 10.0, 1.0, "value"), ("b", "a", 30.0, 5.0, "value"), ("a", "c", 0.5, 9.0, "value")], "source string, target string, weight double, units double, measure string")
    row = one(flow.flow_links(both))
    assert (row.source, row.target, row.weight, row.units) == ("b", "a", 20.0, 4.0)


MOVES = "movement_date timestamp_ntz, movement_type string, quantity double, value double, category string, warehouse string"


@pytest.fixture
def cube_rules(rules):
    return dataclasses.replace(
        rules, movement_types={"receipts": ["RECEIPT", "RECEIVED"], "issues": ["DESPATCH"], "scraps": ["SCRAP"]}, issues_stored_positive=False
    )


def test_cube_totals_per_day_and_category(spark, cube_rules):
    rows = spark.createDataFrame(
        [
            (day("2026-07-01"), "RECEIPT", 100.0, 5000.0, "Fabric", "W"),
            (day("2026-07-01 13:00:00"), "DESPATCH", -40.0, -2000.0, "Fabric ", "W"),
            (day("2026-07-01"), "SCRAP", -1.0, -10.0, "Fabric", "W"),
            (day("2026-07-02"), "RECEIPT", 10.0, 300.0, "", "W"),
        ],
        MOVES,
    )
    out = {(str(r.day), r.category): r for r in cube.category_day_cube(rows, cube_rules).collect()}
    fabric = out["2026-07-01", "Fabric"]
    assert (fabric.ru, fabric.iu, fabric.ou, fabric.rv, fabric.iv, fabric.ov) == (100, -40, -1, 5000, -2000, -10)
    assert out["2026-07-02", "(unspecified)"].ru == 10


def test_smaller_categories_fold_into_other(spark, cube_rules):
    sizes = {f"kind {k:02d}": 5.0 * k * k + 2 for k in range(26)}
    rows = spark.createDataFrame([(day(f"2025-05-{1 + k % 9:02d}"), "RECEIVED", size, 0.0, name, "S") for k, (name, size) in enumerate(sizes.items())], MOVES)
    ranked = sorted(sizes, key=sizes.get, reverse=True)  # by units, as no row has a value
    order = [r.category for r in cube.category_order(rows, cube_rules).orderBy("place").collect()]
    assert order == [*ranked[:20], "Other"]
    out = cube.category_day_cube(rows, cube_rules)
    assert one(out.where("category = 'Other'").agg(F.sum("ru").alias("rest"))).rest == sum(sizes[name] for name in ranked[20:])
    assert one(out.agg(F.sum("ru").alias("all"))).all == sum(sizes.values())


def test_window_net_swaps_bounds_and_drops_dust(spark, cube_rules):
    rows = spark.createDataFrame(
        [(day("2026-07-01"), "RECEIPT", 5.0, 9.0, "a", "W"), (day("2026-07-03"), "DESPATCH", -2.0, -1.0, "a", "W"), (day("2026-07-02"), "RECEIPT", 0.5, 0.5, "b", "W")],
        MOVES,
    )
    table = cube.category_day_cube(rows, cube_rules)
    assert one(cube.window_category_net(table, "2026-07-03", "2026-07-01")).net == 3
    assert one(cube.window_category_net(table, "2026-07-01", "2026-07-03", exclude_end=True)).net == 5
    assert one(cube.window_category_net(table, "2026-07-01", "2026-07-03", "value")).net == 8


POINT = "dataset string, snapshot_date date, quantity double, value double, live boolean"
CUBE = "ledger string, day date, ru double, iu double, au double, ou double"


def _date(text):
    return dt.date.fromisoformat(text)


def _verdicts(spark, points, cubes, start, end, coverage=None):
    points = spark.createDataFrame([(d, _date(t), float(q), None, live) for d, t, q, live in points], POINT)
    cubes = spark.createDataFrame([(s, _date(t), float(u), 0.0, 0.0, 0.0) for s, t, u in cubes], CUBE)
    return {r.dataset: r for r in cube.store_reconciliation(points, cubes, start, end, coverage).collect()}


def test_store_verdicts(spark):
    points = [
        ("rm_balance", "2026-07-01", 1000, False), ("rm_balance", "2026-07-05", 1070, False), ("rm_balance", "2026-07-05", 9, True),
        ("fg_balance", "2026-07-01", 500, False), ("fg_balance", "2026-07-05", 900, True),
        ("wip_balance", "2026-07-01", 10, False), ("wip_balance", "2026-07-04", 16, False),
    ]
    moved = [("rm", "2026-07-01", 70), ("rm", "2026-07-05", 1000), ("fg", "2026-06-30", 400)]
    out = _verdicts(spark, points, moved, "2026-07-06", "2026-07-02", ("2026-07-01", "2026-07-06"))
    assert (out["rm_balance"].verdict, out["rm_balance"].variance, out["rm_balance"].tolerance) == ("reconciles", 0, 5.35)
    assert (out["fg_balance"].verdict, out["fg_balance"].variance) == ("off", 400)
    assert (out["wip_balance"].verdict, out["wip_balance"].change) == ("no ledger", 6)


def test_store_reasons(spark):
    points = [("rm_balance", "2026-07-01", 10, False), ("fg_balance", "2026-06-01", 5, False), ("fg_balance", "2026-07-03", 5, False)]
    out = _verdicts(spark, points, [], "2026-07-02", "2026-07-03", ("2026-07-01", "2026-07-04"))
    assert out["rm_balance"].verdict == out["fg_balance"].verdict == "can't reconcile"
    assert out["rm_balance"].reason.startswith("opening and closing resolve to the same baseline")
    assert out["fg_balance"].reason == "needs baselines inside the movement window"
    assert _verdicts(spark, [], [], "2026-07-02", "2026-07-03")["fg_balance"].reason is None


def test_stock_balances_without_a_baseline(spark):
    schema = "dataset string, snapshot_date date, quantity double, value double"
    history = spark.createDataFrame([("rm_balance", _date("2026-06-01"), 60.0, 3000.0), ("rm_balance", _date("2026-08-01"), 1.0, 1.0)], schema)
    live = spark.createDataFrame([("rm_balance", 70.0, 3500.0), ("fg_balance", 20.0, 900.0)], "dataset string, quantity double, value double")
    out = {r.stock_type: r for r in balances.stock_balances_report(history, live, "2026-07-01").collect()}
    raw, finished, wip = (out[name] for name in ("Raw materials", "Finished goods", "Work in progress"))
    assert (raw.opening_qty, raw.closing_qty, raw.qty_change, raw.value_change, raw.opening_source) == (60, 70, 10, 500, _date("2026-06-01"))
    assert (finished.opening_qty, finished.closing_qty, finished.qty_change) == (None, 20, None)
    assert (wip.closing_qty, wip.closing_value, wip.unit) == (0, None, "R")


def test_rounding_and_sums(spark):
    df = spark.createDataFrame([(2.675, 0.25, -0.3)], "a double, b double, c double")
    row = one(df.select(rounded(F.col("a"), 2).alias("a"), plain_text(F.col("b"), 1).alias("b"), signed_text(F.col("c"), 0).alias("c"), signed_text(F.lit(1234.0), 1).alias("d")))
    assert (row.a, row.b, row.c, row.d) == (2.67, "0.2", "-0", "+1,234.0")


def test_sums_cut_no_digit(spark):
    def total(values, parts=4):
        df = spark.createDataFrame([(x,) for x in values], "v double").repartition(parts)
        return one(df.agg(exact_sum(F.col("v")).alias("s"))).s

    assert total([0.1] * 10 + [1e10, -1e10, 123456789.01]) == 123456790.01
    assert total([9e12, 0.25]) == 9000000000000.25 and total([1e12] * 7 + [0.5]) == 7000000000000.5
    tiny = spark.range(1_000_000).select(F.lit(4e-7).alias("v"))
    assert one(tiny.agg(exact_sum(F.col("v")).alias("s"))).s == pytest.approx(0.4, rel=1e-9)
    assert total([4e-7, 1e-13, -4e-7]) == pytest.approx(1e-13, rel=1e-6) and total([None, None]) is None


def test_two_step_sums_equal_one_step(spark):
    df = spark.createDataFrame([(k % 3, k % 7, k * 0.37 + 1e-8) for k in range(500)], "a int, b int, v double")
    once = {r.a: r.s for r in df.groupBy("a").agg(exact_sum(F.col("v")).alias("s")).collect()}
    steps = df.groupBy("a", "b").agg(*part_sums("v")).groupBy("a").agg(total_of_parts("v").alias("s"))
    assert {r.a: r.s for r in steps.collect()} == pytest.approx(once, rel=1e-14)
