import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyledger import Dataset, LedgerRules
from tallyledger.sources import baseline, canonical, physical, snapshots

from .conftest import day, one

BALANCE = {
    "item_code": ["Model", "Grade"],
    "item_description": "Long Text",
    "warehouse": "Depot",
    "balance_date": None,
    "quantity": "Pieces",
}
STOCK = {
    "item_code": "Part Id",
    "item_description": "Part Text",
    "warehouse": "Bay",
    "balance_date": None,
    "quantity": "On Shelf",
}


def balance(columns, **changes):
    return Dataset("some_balance", "balance", columns | changes)


# ---- mapping checks ----


@pytest.mark.parametrize(
    ("changes", "message"),
    [
        ({"item_code": None}, "cannot be null"),
        ({"item_code": []}, "empty list"),
        ({"quantity": {"product": ["OnlyOne"]}}, "at least two factors"),
        ({"quantity": {"product": [1, 2]}}, "at least one column"),
        ({"quantity": {"product": ["a", None]}}, "column names or numbers"),
        ({"quantity": {"sum": ["a", "b"]}}, "at least two factors"),
    ],
)
def test_bad_mappings_are_rejected(changes, message):
    with pytest.raises(ValueError, match=message):
        balance(BALANCE, **changes)


def test_bad_datasets_and_rules_are_rejected():
    with pytest.raises(ValueError, match="movement or balance"):
        Dataset("x", "ledger", BALANCE)
    with pytest.raises(ValueError, match="missing column mappings"):
        Dataset("x", "movement", BALANCE)
    for rule in ({"column": "a"}, {"column": "a", "equals": None}, "a"):
        with pytest.raises(ValueError, match="exclude_where"):
            Dataset("x", "balance", BALANCE, exclude_where=(rule,))
    for rule in ({}, {"item": "a"}):
        with pytest.raises(ValueError, match="reconcile_exclusions"):
            LedgerRules(reconcile_exclusions=(rule,))


# ---- scans ----


def test_composite_key_null_mapping_and_ignored_window(spark):
    table = spark.createDataFrame(
        [(" pump", "B2 ", "small pump", None, "7.25"), ("hose", None, None, " Bay 9 ", "none")],
        "Model string, Grade string, `Long Text` string, Depot string, Pieces string",
    )
    ds = balance(BALANCE)
    scan = canonical.canonical_scan(table, ds, date_from="2031-05-01", as_of="2025-10-09 07:15:20.9").collect()
    found = {r.item_code: (r.item_description, r.warehouse, r.quantity, r.balance_date) for r in scan}
    read = day("2025-10-09 07:15:20")
    assert found == {"pump|B2": ("small pump", "-", 7.25, read), "hose": ("", "Bay 9", 0.0, read)}
    assert one(canonical.canonical_scan(table, ds, item_code="pump|B2", as_of="2025-10-09")).quantity == 7.25
    assert canonical.canonical_scan(table, ds, item_code="", as_of="2025-10-09").count() == 2
    with pytest.raises(ValueError, match="as_of"):
        canonical.canonical_scan(table, ds)


def test_product_mapping_and_warehouse_without_column(spark):
    table = spark.createDataFrame([("J", 200.0, 35.0), ("K", None, 1.0)], "Job string, Value double, Ratio double")
    ds = balance(BALANCE, item_code="Job", item_description=None, warehouse=None, quantity={"product": ["Value", "Ratio", 0.01]})
    rows = {r.item_code: r.quantity for r in canonical.canonical_scan(table, ds, as_of="2026-07-01").collect()}
    assert rows == {"J": 70.0, "K": 0.0}
    with pytest.raises(ValueError, match="no warehouse column"):
        canonical.canonical_scan(table, ds, warehouse="W", as_of="2026-07-01")


def test_exclusion_keeps_rows_without_a_value(spark):
    table = spark.createDataFrame(
        [("seen", "here"), ("gone", "lost"), ("blank", None)], "`Part Id` string, Mark string"
    ).select("*", F.lit("t").alias("Part Text"), F.lit("b").alias("Bay"), F.lit(2.0).alias("On Shelf"))
    ds = Dataset("rm_balance", "balance", STOCK, exclude_where=({"column": "Mark", "equals": "lost"},))
    rows = canonical.canonical_scan(table, ds, as_of="2026-07-01")
    assert {r.item_code for r in rows.collect()} == {"seen", "blank"}
    assert "Mark" not in rows.columns


@pytest.mark.parametrize(
    ("text", "number"),
    [("12.5", 12.5), (" 3 ", 3.0), ("bad", 0.0), ("NaN", 0.0), ("12d", 0.0), ("1e3", 1000.0), (None, 0.0), ("inf", 0.0), ("1,000", 0.0)],
)
def test_numbers_from_text(spark, text, number):
    from tallyledger.functions.cells import number_or_zero
    from pyspark.sql import types as T

    df = spark.createDataFrame([(text,)], "c string")
    assert one(df.select(number_or_zero(F.col("c"), T.StringType()).alias("n"))).n == number


def test_text_is_cleaned_of_any_white_space(spark):
    table = spark.createDataFrame(
        [(" M/OLIVE \t|  30\n", None, "\tW　", "2026-07-01", " received\x1f", 1.0, " r ")],
        "item string, d string, w string, at string, t string, q double, r string",
    )
    ds = Dataset(
        "fg_movements",
        "movement",
        {"item_code": "item", "item_description": "d", "warehouse": "w", "movement_date": "at", "movement_type": "t", "quantity": "q", "reference": "r"},
    )
    row = one(canonical.canonical_scan(table, ds))
    assert (row.item_code, row.warehouse, row.movement_type, row.reference) == ("M/OLIVE|30", "W", "RECEIVED", "r")
    assert row.movement_date == day("2026-07-01")
    bad = table.withColumn("at", F.lit("soon"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        canonical.canonical_scan(bad, ds).collect()


def test_window_is_half_open(moves):
    rows = moves([("A", "W", d, "GRN", 1, d) for d in ("2026-06-30 23:59:59", "2026-07-01", "2026-07-31 23:59:59", "2026-08-01")])
    inside = canonical.in_window(rows, F.col("movement_date"), dt.date(2026, 7, 1), dt.datetime(2026, 8, 1))
    assert {r.reference for r in inside.collect()} == {"2026-07-01", "2026-07-31 23:59:59"}


def test_union_tags_ledgers_and_fills_missing_columns(moves):
    fg = moves([("A", "W", "2026-07-01", "GRN", 1, "")])
    rm = fg.withColumn("job", F.lit("DO-1"))
    rows = {r.dataset: r.job for r in canonical.ledger_union({"fg_movements": fg, "rm_movements": rm}).collect()}
    assert rows == {"fg_movements": None, "rm_movements": "DO-1"}
    assert canonical.ledger_union({"fg_movements": fg, "rm_movements": rm}, "fg").columns == fg.columns + ["dataset"]


# ---- physical source and sink ----


def test_physical_source_and_sink(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5)], "item_code string, quantity double")
    physical.result_sink(df, str(tmp_path / "csv"))
    physical.result_sink(df, str(tmp_path / "parquet"), format="parquet")
    assert one(spark.read.option("header", True).csv(str(tmp_path / "csv"))).quantity == "1.5"
    assert one(physical.physical_source(spark, path=str(tmp_path / "parquet"))).quantity == 1.5
    df.createOrReplaceTempView("some_stock")
    assert physical.physical_source(spark, table="some_stock").count() == 1
    with pytest.raises(ValueError, match="exactly one"):
        physical.physical_source(spark)


def test_jdbc_options():
    options = physical.jdbc_options({"url": "jdbc:sqlserver://host;databaseName=db", "dbtable": "t"})
    assert options["url"].endswith(";applicationIntent=ReadOnly") and options["preferTimestampNTZ"] == "true"
    with pytest.raises(ValueError, match="split read"):
        physical.jdbc_options({"url": "jdbc:x", "partitionColumn": "d"})


# ---- snapshots ----


def test_csv_snapshots_in_any_encoding(spark, tmp_path):
    text = "item_code,warehouse,item_description,quantity\nAC-1,W1,Navy – trouser,10\n"
    (tmp_path / "a.csv").write_bytes(text.encode("cp1252"))
    (tmp_path / "b.csv").write_bytes(("﻿" + text.replace("AC-1", "00123")).encode("utf-8"))
    (tmp_path / "c.csv").write_bytes(b"item_code,warehouse,quantity,balance_date\nL\x81\x96, W ,bad,never\n")
    (tmp_path / "d.csv").write_bytes(b'quantity,warehouse,item_code,item_description\n7,W,Q,"two\nlines, ""quoted"""\n')
    rows = {r.item_code: r for r in snapshots.snapshot_csv_load(spark, str(tmp_path)).collect()}
    assert rows["AC-1"].item_description == rows["00123"].item_description == "Navy – trouser"
    assert rows["AC-1"].quantity == 10 and rows["AC-1"].balance_date is None
    odd = rows["L\x81\x96"]
    assert (odd.warehouse, odd.quantity, odd.item_description, odd.balance_date) == ("W", 0.0, "", None)
    assert rows["Q"].item_description == 'two\nlines, "quoted"'


def test_csv_without_required_column_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("item_code,quantity\nA,1\n")
    with pytest.raises(ValueError, match="warehouse"):
        snapshots.snapshot_csv_load(spark, str(tmp_path))


def test_captures_replace_their_own_partition_and_prune(spark, held, tmp_path):
    path = str(tmp_path / "table")

    def store(scale):
        lots = held([(f"lot{k}", "dock", "2025-11-02", scale * (k + 1)) for k in range(3)])
        return lots.withColumn("value", F.col("quantity") * 1.5)

    captured = {"rm_balance": store(1), "wip_balance": store(4)}
    snapshots.snapshot_write(captured, path, "2025-11-02")
    snapshots.snapshot_write({"wip_balance": store(9)}, path, "2025-11-05")
    snapshots.snapshot_write(captured, path, "2025-11-02")  # a rerun
    told = snapshots.snapshot_write_summary(snapshots.snapshot_table(spark, path)).collect()
    assert {(r.dataset, str(r.snapshot_date)): (r.rows, r.quantity, r.value) for r in told} == {
        ("rm_balance", "2025-11-02"): (3, 6, 9), ("wip_balance", "2025-11-02"): (3, 24, 36), ("wip_balance", "2025-11-05"): (3, 54, 81),
    }
    history = snapshots.snapshot_history(snapshots.snapshot_table(spark, path)).collect()
    assert [str(r.snapshot_date) for r in history if r.dataset == "wip_balance"] == ["2025-11-02", "2025-11-05"]
    noted = snapshots.snapshot_captures(spark, path).select(*told[0].__fields__)
    assert sorted(noted.collect()) == sorted(told)
    early = snapshots.snapshot_table(spark, path, "wip_balance", "2025-11-04")
    assert early.count() == 3
    assert "PartitionFilters: [isnotnull(dataset" in early._jdf.queryExecution().executedPlan().toString()


def test_a_capture_that_is_not_committed_is_not_seen(spark, held, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    store = lambda scale: {"rm_balance": held([(f"lot{k}", "dock", "2025-11-02", scale * (k + 1)) for k in range(3)])}

    def seen():
        table = snapshots.snapshot_table(spark, path)
        noted = {(r.dataset, str(r.snapshot_date)): (r.rows, r.quantity) for r in snapshots.snapshot_captures(spark, path).collect()}
        told = {(r.dataset, str(r.snapshot_date)): (r.rows, r.quantity) for r in snapshots.snapshot_write_summary(table).collect()}
        assert noted == told and "capture_version" not in table.columns
        return told

    snapshots.snapshot_write(store(1), path, "2025-11-02")
    old = {("rm_balance", "2025-11-02"): (3, 6)}
    assert seen() == old

    def fails(*_):
        raise RuntimeError("the writer dies between the balances and their capture")

    with monkeypatch.context() as broken:
        broken.setattr(snapshots, "_commit", fails)
        for day in ("2025-11-02", "2025-11-03"):
            with pytest.raises(RuntimeError, match="dies"):
                snapshots.snapshot_write(store(100), path, day)
    assert seen() == old
    snapshots.snapshot_write(store(100), path, "2025-11-03")
    assert seen() == old | {("rm_balance", "2025-11-03"): (3, 600)}
    snapshots.snapshot_write(store(5), path, "2025-11-02")
    assert seen() == {("rm_balance", "2025-11-02"): (3, 30), ("rm_balance", "2025-11-03"): (3, 600)}


@pytest.fixture
def dated_files(tmp_path):
    for stamp, count in (("20250105", 3), ("20250219", 8), ("20250401", 5)):
        (tmp_path / f"fg_balance_{stamp}.csv").write_text(f"item_code,warehouse,quantity,balance_date\ncup,hall,{count},2025-{stamp[4:6]}-{stamp[6:]} 09:00\n")
    for other in ("wip_balance_20250219.csv", "fg_balance_2025.csv", "fg_balance_20251340.csv", "notes.csv"):
        (tmp_path / other).write_text("item_code,warehouse,quantity\nother,hall,1\n")
    return str(tmp_path)


def test_the_newest_file_on_or_before_a_date(spark, dated_files):
    found = one(snapshots.newest_snapshot_file(spark, dated_files, "fg_balance", "2025-03-31"))
    assert found.path.endswith("fg_balance_20250219.csv") and str(found.snapshot_date) == "2025-02-19"
    assert one(snapshots.baseline_csv_load(spark, dated_files, "fg_balance", "2025-02-19")).quantity == 8
    with pytest.raises(ValueError, match="no fg_balance snapshot"):
        snapshots.baseline_csv_load(spark, dated_files, "fg_balance", "2025-01-04")
    names = spark.createDataFrame([("a.b_20250101.csv",), ("axb_20250101.csv",)], "file_name string")
    assert [r.file_name for r in snapshots.snapshot_files(names, "a.b").collect()] == ["a.b_20250101.csv"]


def test_files_feed_the_chain(spark, dated_files, moves, rules):
    from tallyledger.operators import chain

    files = [f"{dated_files}/fg_balance_{stamp}.csv" for stamp in ("20250105", "20250219", "20250401")]
    loaded = snapshots.snapshot_csv_load(spark, files)
    assert {(r.file_name, str(r.snapshot_date)) for r in loaded.collect()} == {(f.rpartition("/")[2], f"2025-{f[-8:-6]}-{f[-6:-4]}") for f in files}
    moved = moves([("cup", "hall", "2025-02-01", "GRN", 4, ""), ("cup", "hall", "2025-03-01", "ISSUE", 3, "")])
    assert {r.interval: r.variance for r in chain.reconcile_chain(moved, loaded, rules).collect()} == {1: 1, 2: 0}
    with pytest.raises(Exception, match="at least two snapshots"):
        chain.reconcile_chain(moved, snapshots.snapshot_csv_load(spark, files[0]), rules).collect()


# ---- baseline import ----


def test_import_repairs_keys_and_drops_blank_rows(spark):
    cells = "Model string, Grade double, `Long Text` string, Depot string, Pieces double"
    sheet = spark.createDataFrame(
        [("pump ", 7.0, "grey", "Bay 1", 11.0), ("pump", 7.0, "blue", "Bay 1", 2.5), (None, None, "filler", "Bay 1", None), ("pump", 9.0, "grey", None, 1.0)],
        cells,
    )
    rows = {(r.item_code, r.warehouse): (r.quantity, r.item_description, r.balance_date) for r in baseline.baseline_import(sheet, balance(BALANCE), "2025-10-01").collect()}
    read = day("2025-10-01")
    assert rows == {("pump|7", "Bay 1"): (13.5, "blue", read), ("pump|9", "-"): (1.0, "grey", read)}
    mistaken = spark.createDataFrame([("cap", dt.datetime(2025, 9, 4), "", "Bay 2", 3.0)], cells.replace("Grade double", "Grade timestamp"))
    assert one(baseline.baseline_import(mistaken, balance(BALANCE), "2025-10-01")).item_code == "cap|9/4"


def test_import_multiplies_factors(spark):
    sheet = spark.createDataFrame([("job 8", "line", "dock", 640.0, 12.5), ("job 8", "line", "dock", 16.0, 12.5)], "Order string, What string, Site string, Worth double, Share double")
    ds = balance(BALANCE, item_code="Order", item_description="What", warehouse="Site", quantity={"product": ["Worth", "Share", 0.01]})
    assert one(baseline.baseline_import(sheet, ds, "2025-10-01")).quantity == pytest.approx(82.0)


def test_import_names_the_missing_column_and_unknown_sheets(spark):
    sheet = spark.createDataFrame([("a", "b", "c")], "`Part Id` string, `Part Text` string, Bay string")
    with pytest.raises(KeyError, match="On Shelf"):
        baseline.baseline_import(sheet, balance(STOCK), "2026-07-07")
    with pytest.raises(ValueError, match="no known sheets"):
        baseline.baseline_imports({"Sheet1": sheet}, {}, "2026-07-07")


def test_a_path_is_taken_apart_once_per_file(spark, tmp_path):
    """The rows of a snapshot look their file up; no pattern runs over paths beside them."""
    for day, quantity in (("20260101", 1), ("20260201", 2)):
        folder = tmp_path / f"fg_balance_{day}.csv"
        folder.mkdir()
        for part in range(2):
            (folder / f"part-{part}.csv").write_text(f"item_code,warehouse,quantity\nA{part},W,{quantity}\n")
    (tmp_path / "own.csv").write_text("item_code,warehouse,quantity\nB,W,3\n")
    df = snapshots.snapshot_csv_load(spark, [f"{tmp_path}/fg_balance_20260101.csv", f"{tmp_path}/fg_balance_20260201.csv", f"{tmp_path}/own.csv"])
    found = {(r.item_code, r.file_name, str(r.snapshot_date), r.quantity) for r in df.collect()}
    assert found == {
        (f"A{part}", f"fg_balance_{day}.csv", date, q)
        for day, date, q in (("20260101", "2026-01-01", 1.0), ("20260201", "2026-02-01", 2.0))
        for part in range(2)
    } | {("B", "own.csv", "None", 3.0)}
    lines = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "regexp_extract" in x]
    assert not any("_metadata" in x or "file_path" in x for x in lines)
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
