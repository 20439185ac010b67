import pytest
from pyspark.sql import functions as F

from tallyledger.operators import discovery, narrative

from .conftest import one

SUMMARY = "item_code string, warehouse string, receipt double, issue double, adjustment double, other double, net double"
RECONCILED = (
    "item_code string, warehouse string, item_description string, opening_qty double, net_movement double, "
    "closing_qty double, expected_closing double, variance double, within_tolerance boolean"
)
FINDINGS = "kind string, item_code string, warehouse string, detail string, value double"


def lines(df):
    return [r.line for r in df.orderBy("line_no").collect()]


def test_summary_tells_totals_and_the_largest_movers(spark):
    df = spark.createDataFrame(
        [("nut", "east", 40.0, -2.0, 5.0, 0.0, 43.0), ("nut", "west", 0.0, -7.0, 0.0, 0.0, -7.0), ("rod", "west", 0.0, -2050.5, 0.0, 0.0, -2050.5)], SUMMARY
    )
    assert lines(narrative.explain_summary(df)) == [
        "Across 2 items and 2 warehouse(s): received 40, issued 2,060, adjusted +5, for a net stock change of -2,014 units.",
        "rod (rod) in west drew down 2,050 units net.",
        "nut (nut) in east built up 43 units net.",
        "nut (nut) in west drew down 7 units net.",
    ]
    assert len(lines(narrative.explain_summary(df, top_n=2))) == 3
    assert lines(narrative.explain_summary(df.limit(0))) == ["No movements found in the selected period."]


def test_summary_rows_are_dealt_into_the_partitions_of_the_session(spark):
    """Adaptive execution may not merge the totals per key into a partition a core, nor may they be added up beside the summary."""
    df = spark.createDataFrame([("nut", "east", 40.0, -2.0, 5.0, 0.0, 43.0), ("nut", "east", 1.0, 0.0, 0.0, 0.0, 1.0)], SUMMARY)
    plan = narrative.top_movers(df)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert [(r.item_code, r.net) for r in narrative.top_movers(df).collect()] == [("nut", 44.0)]


def test_reconciliation_tells_what_does_not_add_up(spark):
    df = spark.createDataFrame(
        [("rod", "east", "Steel rod", 8.0, -3.5, 1.5, 4.5, -3.0, False), *[(f"even{k}", "east", "", 2.0, 0.0, 2.0, 2.0, 0.0, True) for k in range(3)]],
        RECONCILED,
    )
    first, second = lines(narrative.explain_reconciliation(df))
    assert first == "Reconciled 4 item/warehouse combinations: 3 balance, 1 show unexplained variance."
    assert second.startswith("rod (Steel rod) in east: closing balance is 1.5 but opening 8.0 plus recorded movements -3.5 predicts 4.5 — 3.0 units less than")
    assert lines(narrative.explain_reconciliation(df.limit(0))) == ["Nothing to reconcile for the selected period."]


def test_anomaly_lines(spark):
    df = spark.createDataFrame(
        [("dormant_item", "D", "W", "no movement", 91.0), ("negative_balance", "rod", "east", "balance -2.5 on 2025-08-30", -2.5), ("odd", "X", "W", "something", 0.0)],
        FINDINGS,
    )
    out = lines(narrative.explain_anomalies(df))
    assert out[0].startswith("rod in east has a NEGATIVE balance: balance -2.5 on 2025-08-30. Stock was issued")
    assert out[1].startswith("D in W is dormant: no movement.") and out[2] == "X in W: something" and len(out) == 3
    assert lines(narrative.explain_anomalies(df, top_n=2))[-1] == "...and 1 more finding(s); export with --csv for the full list."
    assert lines(narrative.explain_anomalies(df.limit(0))) == ["No anomalies detected."]


MOVEMENT_COLUMNS = [("Product_Code", "nvarchar(40)"), ("Depot_Warehouse", "string"), ("Doc_Type", "string"), ("Movement_Date", "timestamp_ntz"), ("Moved_Quantity", "decimal(18,2)"), ("Ref_No", "string"), ("Long_Description", "string")]
BALANCE_COLUMNS = [("On_Hand_Quantity", "double"), ("Balance_Date", "timestamp"), ("Warehouse_Name", "string"), ("Product_Code", "string"), ("Description_Text", "string")]


@pytest.fixture
def catalog(spark):
    def build(tables):
        rows = [("dbo", table, name, dtype, i) for table, columns in tables.items() for i, (name, dtype) in enumerate(columns, 1)]
        return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, data_type string, ordinal int")

    return build


def suggested(df):
    out = {}
    for r in discovery.discover_datasets(df).collect():
        out.setdefault(r.dataset, {"table": r.table_name})[r.canonical] = r.column_name
    return out


NAMES = {
    "fg_movements": "FG_Movement_Log",
    "rm_movements": "Fabric_Transactions",
    "wip_balance": "WIP_Balance_Daily",
    "fg_balance": "Finished_Stock_Levels",
    "rm_balance": "Raw_Stock_Levels",
}


def test_each_dataset_finds_its_table_and_columns(catalog):
    tables = {name: MOVEMENT_COLUMNS if key.endswith("movements") else BALANCE_COLUMNS for key, name in NAMES.items()}
    out = suggested(catalog(tables | {"Price_List": [("Product_Code", "string")]}))
    assert {key: found["table"] for key, found in out.items()} == NAMES
    moved, stock = out["rm_movements"], out["wip_balance"]
    assert (moved["movement_date"], moved["quantity"], moved["warehouse"]) == ("Movement_Date", "Moved_Quantity", "Depot_Warehouse")
    assert (stock["balance_date"], stock["quantity"], stock["item_description"]) == ("Balance_Date", "On_Hand_Quantity", "Description_Text")


def test_dates_and_quantities_need_a_fitting_type(catalog):
    texts = [(name, "string") for name, _ in MOVEMENT_COLUMNS]
    df = catalog({"FG_Movement_Log": texts})
    found = suggested(df)["fg_movements"]
    assert found["movement_date"] is None and found["quantity"] is None and found["warehouse"] == "Depot_Warehouse"
    gaps = {r.dataset: r.unmapped_columns for r in discovery.discovery_gaps(discovery.discover_datasets(df)).collect()}
    assert {"movement_date", "quantity"} <= set(gaps["fg_movements"].split(", ")) and gaps["wip_balance"] == ""


def test_discovery_over_the_session_catalog(spark):
    spark.sql(
        "CREATE OR REPLACE TEMP VIEW fg_stock_seen AS SELECT 'x' AS ItemCode, 'y' AS Warehouse, timestamp '2025-01-01' AS BalanceDate,"
        " CAST(1 AS double) AS Quantity, timestamp_ntz '2025-01-01' AS AsAtDate, CAST(1 AS decimal(18,2)) AS Qty2"
    )
    mine = discovery.catalog_columns(spark).where("table_name = 'fg_stock_seen'")
    found = {r.canonical: r.column_name for r in discovery.discover_datasets(mine).where("dataset = 'fg_balance'").collect()}
    assert (found["balance_date"], found["quantity"]) == ("BalanceDate", "Quantity")
    for dropped, date, amount in (("BalanceDate", "AsAtDate", "Quantity"), ("Quantity", "BalanceDate", "Qty2")):
        rest = {r.canonical: r.column_name for r in discovery.discover_columns(mine.where(F.col("column_name") != dropped)).collect()}
        assert (rest["balance_date"], rest["quantity"]) == (date, amount)


def test_no_candidate(catalog):
    out = suggested(catalog({"Price_List": [("Product_Code", "string")]}))
    assert out["fg_movements"] == {"table": None, None: None} and len(out) == 5


def test_list_columns_and_session_catalog(spark, catalog):
    df = catalog({"B": BALANCE_COLUMNS, "A": MOVEMENT_COLUMNS})
    assert [r.column_name for r in discovery.list_columns(df, ["B"]).collect()] == [name for name, _ in BALANCE_COLUMNS]
    spark.range(1).select(F.lit("x").alias("ItemCode"), F.lit(1.5).alias("Qty")).createOrReplaceTempView("fg_stock_view")
    mine = discovery.catalog_columns(spark).where("table_name = 'fg_stock_view'")
    assert [(r.column_name, r.data_type) for r in mine.orderBy("ordinal").collect()] == [("ItemCode", "string"), ("Qty", "double")]
