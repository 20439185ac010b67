"""Registered queries against their SQL, on the smallest driver tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from workload import oracles, registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
# One query per family here; every registered query has an oracle and is compared by the driver.
NAMES = (
    "normalize_movements",
    "movement_summary",
    "movement_summary_buckets",
    "category_day_cube_folded",
    "snapshot_asof",
    "stock_balances_report",
    "baseline_asof_join",
    "balance_before",
    "item_filter_composite",
    "baseline_import",
    "reconcile_dated",
    "chain_classify",
    "robust_stats_split",
    "anomalies",
    "flow_links",
    "explain_reconciliation",
    "discover_datasets",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return ""
        return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)

    return sorted(columns), sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_every_query_has_an_oracle():
    assert registry.queries().keys() == oracles.oracle_sql().keys()
    assert registry.queries().keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, SF)
    found = sql.execute(__spark_entry__.oracle_sql()[name])
    assert _rows(df.columns, df.collect()) == _rows([c[0] for c in found.description], found.fetchall())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_captures_collect_no_parts_and_count_parts_listed_twice(spark, tmp_path):
    """Parts are dealt out to the joins of a capture, not broadcast; a part listed twice doubles what moved."""
    from workload import tables

    for name in TABLES:
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        (rows.union(rows) if name == "part" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    moved = {}
    for folder in (SF, str(tmp_path)):
        held = tables._captures(spark, folder, "fg_movements")
        plan = held._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and not any("Broadcast" in x and "p_partkey" in x for x in plan.splitlines())
        plain = held.where("l_partkey % 11 != 0 AND l_partkey % 13 != 0 AND l_partkey % 17 != 0")
        moved[folder] = {(r.item_code, r.warehouse, r.snapshot_date): r.quantity - 200.0 for r in plain.collect()}
    assert len(moved[SF]) > 100
    assert moved[str(tmp_path)] == {key: 2 * quantity for key, quantity in moved[SF].items()}
