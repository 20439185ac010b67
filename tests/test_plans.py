"""What the physical plans must look like, and whole reports from physical tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tallyledger import Dataset
from tallyledger.operators import anomalies, balances, chain, cube, narrative, reconcile, summaries
from tallyledger.plans.inventory import Inventory
from tallyledger.sources import baseline, canonical
from workload import registry, tables

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
RULES = tables.RULES


def plan(df):
    """The physical plan, filters and schemas in full."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|single|Single)", plan(df)))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The derived ledger and snapshots as plain tables, so that plans show the operators alone."""
    root = str(tmp_path_factory.mktemp("stored"))
    registry.ledger(spark, SF).write.parquet(f"{root}/ledger")
    tables.snapshots(spark, SF, "fg_movements").write.partitionBy("snapshot_date").parquet(f"{root}/snaps")
    tables.fg_ledger_table(spark, SF).write.parquet(f"{root}/fg")
    return lambda name: spark.read.parquet(f"{root}/{name}")


@needs_data
def test_date_window_and_columns_reach_the_scan(stored):
    scan = canonical.canonical_scan(stored("fg"), tables.FG_LEDGER, date_from="1998-01-01", date_to="1999-01-01")
    text = plan(summaries.movement_net(scan, RULES))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1).replace("`", "")
    assert "GreaterThanOrEqual(Moved On,1998-01-01T00:00)" in pushed and "LessThan(Moved On,1999-01-01T00:00)" in pushed
    assert "Product Desc" not in text.split("ReadSchema")[1] and shuffles(summaries.movement_net(scan, RULES)) == 1


@needs_data
def test_keys_reach_the_scan(spark):
    pushed = lambda name: " ".join(re.findall(r"PushedFilters: \[(.*?)\]", plan(registry.queries()[name](spark, SF))))
    assert "EqualTo(l_partkey,7)" in pushed("item_filter_composite") and "EqualTo(p_size," in pushed("item_filter_composite")
    assert "StringContains(r_name,ASIA)" in pushed("warehouse_filter")


@needs_data
def test_numeric_keys_are_not_trimmed(stored):
    text = plan(canonical.canonical_scan(stored("fg"), tables.FG_LEDGER).select("item_code"))
    assert "trim(" not in text and "regexp" not in text


@needs_data
def test_summaries_need_one_shuffle_and_no_sort(stored):
    for df in (
        summaries.movement_summary(stored("ledger"), RULES),
        summaries.category_summary(stored("ledger"), RULES, ordered=False),
        summaries.movement_types(stored("ledger"), ordered=False),
    ):
        assert shuffles(df) == 1 and "SortAggregate" not in plan(df) and "Python" not in plan(df)


@needs_data
def test_reconcile_is_one_aggregate_without_joins(stored):
    snap = stored("snaps")
    one_day = lambda d: snap.where(F.col("snapshot_date") == F.lit(d).cast("date"))
    df = reconcile.reconcile(one_day("1998-01-01"), stored("ledger"), one_day("1998-07-01"), RULES)
    assert shuffles(df) == 2 and "Join" not in plan(df) and "CartesianProduct" not in plan(df)
    assert plan(df).count("partial_sum") >= 1  # rows combine before the shuffle


@needs_data
def test_chain_and_classes_share_one_exchange_on_the_item(stored):
    df = chain.chain_classify(chain.reconcile_chain(stored("ledger"), stored("snaps"), RULES))
    text = plan(df)
    main = [line for line in text.splitlines() if "Exchange hashpartitioning(item_code" in line]
    assert len(main) == 2, main  # rows to (key, period), then once to the item
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SortMergeJoin" not in text  # only the calendar, cuts and labels are joined


@needs_data
def test_snapshot_asof_reads_only_dates_before(stored):
    df = balances.snapshot_asof(stored("snaps").withColumn("balance_date", F.col("balance_date")), "1998-08-01")
    assert "LessThanOrEqual(balance_date,1998-08-01T00:00)" in plan(df) and shuffles(df) == 2


@needs_data
def test_opening_balance_prunes_partitions(stored):
    history = stored("snaps")
    live = history.select("dataset", "quantity", "value")
    text = plan(balances.stock_balances_report(history, live, "1998-08-01"))
    assert re.search(r"PartitionFilters: \[[^]]*snapshot_date[^]]*ubquery", text), text


@needs_data
def test_no_query_calls_python_or_crosses_tables(spark):
    for name, query in registry.queries().items():
        text = plan(query(spark, SF))
        for word in ("CartesianProduct", "ArrowEvalPython", "BatchEvalPython", "BroadcastNestedLoopJoin"):
            assert word not in text, (name, word)


def scans(df):
    """Scans of the plan that ran, those below a reused exchange counted once."""
    df.collect()
    text = plan(df)
    return len(re.findall(r"FileScan parquet", text[: text.find("== Initial Plan ==")]))


@needs_data
def test_captures_answer_without_reading_balances(spark):
    for name in ("snapshot_history", "baseline_asof", "baseline_asof_join"):
        text = plan(registry.queries()[name](spark, SF))
        assert "_captures" in text and "balance_date" not in text, name


@needs_data
def test_one_pass_serves_ranking_totals_and_sentences(stored):
    rows = stored("ledger")
    summary = summaries.movement_summary(rows, RULES)
    one_day = lambda d: stored("snaps").where(F.col("snapshot_date") == F.lit(d).cast("date"))
    rec = reconcile.reconcile(one_day("1998-01-01"), rows, one_day("1998-07-01"), RULES)
    assert scans(cube.category_day_cube(rows, RULES)) == 1
    assert scans(narrative.explain_summary(summary)) == 1 and "Expand" not in plan(narrative.explain_summary(summary))
    assert scans(narrative.explain_reconciliation(rec)) == 3  # two snapshots and the ledger
    assert scans(anomalies.anomalies(rows, None, RULES)) <= 3  # counts; their join back; the newest date
    assert scans(narrative.explain_anomalies(anomalies.anomalies(rows, None, RULES, "2001-12-01"))) <= 4


@needs_data
def test_anomalies_read_each_ledger_once_and_add_up_no_texts(spark):
    df = registry.queries()["anomalies"](spark, SF)
    df.collect()
    text = plan(df)
    ran = text[: text.find("== Initial Plan ==")]
    assert len(re.findall(r"FileScan parquet \[l_orderkey", ran)) == 2  # quantities meet where movements do
    assert "SortAggregate" not in ran and "Join [item_code" not in ran.replace("BroadcastHashJoin", "")
    assert not re.search(r"FileScan parquet \[[^]]*(item_description|value)", ran)


@needs_data
def test_findings_told_are_looked_for_once(stored):
    found = anomalies.anomalies(stored("ledger"), None, RULES, "2001-12-01")
    assert plan_that_ran(narrative.explain_anomalies(found)).count("- Window [") == plan_that_ran(found).count("- Window [") > 0


def plan_that_ran(df):
    df.collect()
    text = plan(df)
    return text[: text.find("== Initial Plan ==")]


@needs_data
def test_numbers_combine_before_any_sort(stored):
    snap, rows = stored("snaps"), stored("ledger")
    sheet = snap.select("item_code", "item_description", "warehouse", "quantity")
    ds = Dataset("fg_balance", "balance", {name: name for name in sheet.columns} | {"balance_date": None})
    for df in (
        balances.snapshot_current(snap),
        balances.snapshot_asof(snap, "1999-01-01"),
        baseline.baseline_import(sheet, ds, "1999-01-01"),
        reconcile.reconcile(snap, rows, snap, RULES),
        reconcile.item_description_lookup(snap, snap, rows),
        chain.reconcile_chain(rows, snap, RULES),
        anomalies.negative_balance(snap),
    ):
        text = plan(df)
        text = text[text.find("== Initial Plan ==") :] if "== Initial Plan ==" in text else text
        for scan in re.finditer(r"FileScan", text):
            before = text[: scan.start()].splitlines()
            below = []
            for line in reversed(before):  # from the scan up to the first exchange above it
                if "Exchange" in line:
                    break
                below.append(line)
            assert not any("Sort" in line for line in below), text


@pytest.fixture(scope="module")
def inventory(spark):
    return Inventory(
        tables.DATASETS,
        {
            "fg_movements": tables.fg_ledger_table(spark, SF),
            "rm_movements": tables.rm_ledger_table(spark, SF),
            "fg_balance": tables.fg_stock_table(spark, SF),
            "rm_balance": tables.rm_stock_table(spark, SF),
            "wip_balance": tables.wip_job_table(spark, SF),
        },
        RULES,
    )


@needs_data
def test_reports_run_from_physical_tables(spark, inventory, tmp_path):
    start, end, now = "1998-01-01", "2000-01-01", "2001-12-01"
    history = tables.history(spark, SF)
    first = registry.capture(spark, SF, tables.SNAPSHOT_DATES[0])
    results = {
        "summary": inventory.summary("all", start, end),
        "reconcile": inventory.reconcile("fg", opening=first, now=now),
        "chain": inventory.reconcile_chain("fg", tables.snapshots(spark, SF, "fg_movements")),
        "report": inventory.report(start, end, history),
        "dashboard": inventory.dashboard(start, end, history),
        "flow": inventory.flow("all", start, end),
        "anomalies": inventory.anomalies("all", start, end),
        "movements": inventory.movements("rm", start, end, warehouse="ASIA"),
        "import": inventory.import_baseline({"Product_Stock": tables.export_rows(spark, SF)}, now),
        "more": {"types": inventory.types("fg"), "snapshot": inventory.snapshot("wip_balance", now)},
    }
    for report, frames in results.items():
        for name, df in frames.items():
            assert df.limit(1).count() == (0 if (report, name) == ("none", "") else 1), (report, name)
    captured = inventory.snapshot_all(str(tmp_path / "snaps"), now, "2001-11-30").collect()
    assert {(r.dataset, str(r.snapshot_date)) for r in captured} == {(name, "2001-11-30") for name in ("rm_balance", "fg_balance", "wip_balance")}


@needs_data
def test_report_arguments_are_checked(inventory):
    with pytest.raises(ValueError, match="choose fg or rm"):
        inventory.reconcile("all")
    with pytest.raises(ValueError, match="choose fg or rm"):
        inventory.reconcile_chain("all", None)
    with pytest.raises(ValueError, match="needs an opening"):
        inventory.reconcile("fg", closing=inventory.tables["fg_balance"])
    with pytest.raises(ValueError, match="current-state"):
        inventory.reconcile("fg", date_from="1998-01-01", date_to="1999-01-01")
    with pytest.raises(ValueError, match="not a balance"):
        inventory.snapshot("fg_movements", "1999-01-01")
