"""The driver's star schema seen as the physical tables of an inventory database.

Nothing here is part of the engine: it only renames and derives, so that every operator has whole
tables to work on. Line items are movements (lines 1-4 finished goods, 5-7 raw materials) and, in a
second reading, lots in stock; open orders are work in progress.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyledger import Dataset, LedgerRules
from tallyledger.functions.reuse import dealt
from tallyledger.sources.scratch import checkpoint_folder
from tallyledger.sources.snapshots import captures_write, snapshot_captures

# The movement types of each direction.
RULES = LedgerRules(
    movement_types={
        "receipts": [
            "RECEIVED",
            "TRANSFERRED IN",
            "WAREHOUSE TRANSFER IN",
            "RETURNED",
            "RECEIPT",
            "RETURN",
        ],
        "issues": [
            "INVOICED",
            "TRANSFERRED OUT",
            "WAREHOUSE TRANSFER OUT",
            "PICKED",
            "DESPATCH CANCELLED",
            "DESPATCH CANCELLED - REJECTED",
            "DESPATCH",
            "SALE STOCK",
            "RTV",
            "CANCELLED DESPATCH",
        ],
        "adjustments": [
            "STOCK ADJ IN - STOCK ADJUST- IN",
            "STOCK ADJ OUT - STOCK ADJUST - OUT",
            "STOCK ADJ IN - STOCK TAKE IN",
            "STOCK ADJ OUT - STOCK TAKE OUT",
            "STOCK ADJ OUT - INSPECTION (PROCESSING) - OUT",
            "STOCK ADJ OUT - REJECT ADJUST - OUT",
            "STOCK ADJ OUT - THEFT",
            "STOCK ADJ IN",
            "STOCK ADJ OUT",
        ],
    },
    reconcile_exclusions=({"movement_type": "STOCK ADJ IN - STOCK ADJUST- IN", "warehouse": "AFRICA"},),
    issues_stored_positive=False,
)

# The four captures of the snapshot history.
SNAPSHOT_DATES = ("1998-01-01", "1998-07-01", "1999-01-01", "1999-07-01")

# When the current-state tables count as read.
READ_AT = "2001-12-01 08:30:15"

# Movement type of a line, by its flag, status and number.
_FG_TYPE = """
CASE WHEN l_returnflag = 'A' THEN 'RECEIVED'
     WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'INVOICED'
     WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'PICKED'
     WHEN l_linestatus = 'F' THEN CASE l_linenumber
       WHEN 1 THEN 'RETURNED' WHEN 2 THEN 'TRANSFERRED IN' WHEN 3 THEN 'TRANSFERRED OUT' ELSE 'DESPATCH CANCELLED' END
     ELSE CASE l_linenumber
       WHEN 1 THEN 'STOCK ADJ IN - STOCK TAKE IN' WHEN 2 THEN 'STOCK ADJ OUT - STOCK TAKE OUT' WHEN 3 THEN 'ASN'
       ELSE 'STOCK ADJ IN - STOCK ADJUST- IN' END END"""
_RM_TYPE = """
CASE WHEN l_returnflag = 'A' THEN 'RECEIPT'
     WHEN l_returnflag = 'N' THEN 'DESPATCH'
     WHEN l_linestatus = 'F' THEN CASE l_linenumber WHEN 5 THEN 'RETURN' WHEN 6 THEN 'SALE STOCK' ELSE 'RTV' END
     ELSE CASE l_linenumber WHEN 5 THEN 'STOCK ADJ IN' WHEN 6 THEN 'STOCK ADJ OUT' ELSE 'CANCELLED DESPATCH' END END"""
# Whether a line leaves its store.
_FG_OUTWARD = "l_returnflag = 'N' OR (l_returnflag = 'R' AND ((l_linestatus = 'F' AND l_linenumber = 3) OR (l_linestatus = 'O' AND l_linenumber = 2)))"
_RM_OUTWARD = "l_returnflag = 'N' OR (l_returnflag = 'R' AND ((l_linestatus = 'F' AND l_linenumber >= 6) OR (l_linestatus = 'O' AND l_linenumber = 6)))"

# Columns of the driver tables used here.
_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

FG_LEDGER = Dataset(
    "fg_movements",
    "movement",
    {
        "item_code": ["Style #", "Size"],
        "item_description": "Product Desc",
        "warehouse": "Warehouse",
        "movement_date": "Moved On",
        "movement_type": "Move Type",
        "quantity": "Units",
        "reference": "Doc",
        "job": "Job",
        "value": "Move Value",
        "category": "Product",
    },
)
RM_LEDGER = Dataset(
    "rm_movements",
    "movement",
    {
        "item_code": "Stock No",
        "item_description": "Stock Desc",
        "warehouse": "Location",
        "movement_date": "Moved On",
        "movement_type": "Move Type",
        "quantity": "Units",
        "reference": "Doc",
        "job": "Job",
        "value": "Move Value",
        "category": "Cost Type",
    },
)
FG_STOCK = Dataset(
    "fg_balance",
    "balance",
    {
        "item_code": ["Style #", "Size"],
        "item_description": "Product Desc",
        "warehouse": "Warehouse",
        "balance_date": None,
        "quantity": "Units",
        "value": {"product": ["Units", "Stock Cost"]},
        "category": "Product",
    },
)
RM_STOCK = Dataset(
    "rm_balance",
    "balance",
    {
        "item_code": "Stock No",
        "item_description": "Stock Desc",
        "warehouse": "Location",
        "balance_date": None,
        "quantity": "SOH Units",
        "value": {"product": ["SOH Units", "Stock Cost"]},
        "category": "Cost Type",
    },
    exclude_where=({"column": "ItemStatus", "equals": "Missing"},),
)
WIP_JOBS = Dataset(
    "wip_balance",
    "balance",
    {
        "item_code": "Job No",
        "item_description": None,
        "warehouse": "Customer",
        "balance_date": None,
        "quantity": {"product": ["Job Value", "Ratio", 0.01]},
        "value": "Job Value",
        "category": "Priority",
    },
)
DATASETS = {ds.name: ds for ds in (FG_LEDGER, RM_LEDGER, FG_STOCK, RM_STOCK, WIP_JOBS)}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _placed(spark: SparkSession, sf_dir: str, first: int, last: int) -> DataFrame:
    """Lines with their region. Joined table by table, so that each is judged by its own size; nation and region are of
    fixed size."""
    line = driver_table(spark, sf_dir, "lineitem").where(F.col("l_linenumber").between(first, last))
    return (
        line.join(driver_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(driver_table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(driver_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def _with_parts(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their part. Its file is many times smaller than its rows, by which Spark would collect and broadcast
    parts with all their texts; dealt out by key they stay with the executors."""
    part = driver_table(spark, sf_dir, "part").hint("shuffle_hash")
    return rows.join(part, F.col("l_partkey") == F.col("p_partkey"))


def _lines(spark: SparkSession, sf_dir: str, first: int, last: int) -> DataFrame:
    """Lines with their part and region."""
    return _with_parts(_placed(spark, sf_dir, first, last), spark, sf_dir)


def _moved(lines: DataFrame, kind: str, outward: str, *rest: str) -> DataFrame:
    """Lines as movements; every 499th order was keyed with forty times the quantity."""
    sign = f"IF({outward}, -1.0D, 1.0D)"
    return lines.selectExpr(
        f"{kind} AS `Move Type`",
        f"{sign} * l_quantity * IF(l_orderkey % 499 = 0, 40.0D, 1.0D) AS Units",
        f"{sign} * l_extendedprice AS `Move Value`",
        "l_shipdate AS `Moved On`",
        "'D' || l_orderkey AS Doc",
        "l_orderkey AS Job",
        *rest,
    )


def fg_ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(
        _lines(spark, sf_dir, 1, 4),
        _FG_TYPE,
        _FG_OUTWARD,
        "l_partkey AS `Style #`",
        "p_size AS Size",
        "p_name AS `Product Desc`",
        "r_name AS Warehouse",
        "p_brand AS Product",
    )


def rm_ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(
        _lines(spark, sf_dir, 5, 7),
        _RM_TYPE,
        _RM_OUTWARD,
        "'RM' || l_partkey AS `Stock No`",
        "p_name AS `Stock Desc`",
        "r_name AS Location",
        "p_type AS `Cost Type`",
    )


def untidy_ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finished-goods ledger as people type it: loose blanks, bad numbers, gaps, lower case."""
    order = F.col("Job")
    return fg_ledger_table(spark, sf_dir).select(
        F.concat(F.col("Style #").cast("string"), F.lit(" \t| "), F.col("Size").cast("string"), F.lit(" ")).alias("Key"),
        F.when(order % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("\t"), "Product Desc", F.lit("  "))).alias("Product Desc"),
        F.when(order % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), "Warehouse")).alias("Warehouse"),
        F.date_format("Moved On", "yyyy-MM-dd HH:mm:ss").alias("Moved On"),
        F.when(order % 17 == 0, F.lit(None)).otherwise(F.concat(F.lower("Move Type"), F.lit("\n"))).alias("Move Type"),
        F.when(order % 211 == 0, "bad").when(order % 223 == 0, "NaN").when(order % 227 == 0, "12d").otherwise(F.col("Units").cast("string")).alias("Units"),
        "Doc",
        order,
        "Move Value",
        "Product",
    )


UNTIDY_LEDGER = Dataset(
    "fg_movements",
    "movement",
    FG_LEDGER.columns | {"item_code": "Key"},
)


def fg_stock_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finished-goods line as one lot in stock."""
    return _lines(spark, sf_dir, 1, 4).select(
        F.col("l_partkey").alias("Style #"),
        F.col("p_size").alias("Size"),
        F.col("p_name").alias("Product Desc"),
        F.col("r_name").alias("Warehouse"),
        F.col("l_quantity").alias("Units"),
        F.col("p_retailprice").alias("Stock Cost"),
        F.col("p_brand").alias("Product"),
    )


def rm_stock_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    return _lines(spark, sf_dir, 5, 7).select(
        F.concat(F.lit("RM"), part.cast("string")).alias("Stock No"),
        F.col("p_name").alias("Stock Desc"),
        F.col("r_name").alias("Location"),
        F.col("l_quantity").alias("SOH Units"),
        F.col("p_retailprice").alias("Stock Cost"),
        F.col("p_type").alias("Cost Type"),
        F.when(part % 29 == 0, "Missing").when(part % 31 != 0, "OK").alias("ItemStatus"),
    )


def wip_job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = driver_table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "F")
    # As parts: few bytes a row in the file, but a row per customer.
    customers = driver_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").hint("shuffle_hash")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("DO-"), F.col("o_orderkey").cast("string")).alias("Job No"),
        F.col("c_mktsegment").alias("Customer"),
        F.col("o_totalprice").alias("Job Value"),
        (F.col("o_orderkey") % 101).alias("Ratio"),
        F.col("o_orderpriority").alias("Priority"),
        F.col("o_orderdate").alias("Opened"),
    )


def _captures(spark: SparkSession, sf_dir: str, ledger: str) -> DataFrame:
    """Four captures of a ledger's stock: 200 plus everything moved before the capture, plus drift.

    Parts divisible by 11 drift steadily, by 13 once and back, by 17 partly back.
    """
    finished = ledger == "fg_movements"
    placed = _placed(spark, sf_dir, *((1, 4) if finished else (5, 7)))
    item = "concat_ws('|', l_partkey, p_size)" if finished else "'RM' || l_partkey"
    category = "p_brand" if finished else "p_type"
    # Added up per part and region before the parts' texts come in.
    sums = (
        _moved(placed, _FG_TYPE if finished else _RM_TYPE, _FG_OUTWARD if finished else _RM_OUTWARD, "l_partkey", "r_name")
        .groupBy("l_partkey", "r_name")
        .agg(
            *[
                F.expr(f"sum(IF(`Moved On` < TIMESTAMP_NTZ'{day} 00:00:00', Units, 0.0D)) AS moved_{i}")
                for i, day in enumerate(SNAPSHOT_DATES)
            ]
        )
    )
    # A part may be listed several times; its movements then count as often.
    columns = ("p_partkey", "p_size", "p_name", "p_retailprice", category)
    listed = driver_table(spark, sf_dir, "part").groupBy(*columns).agg(F.count(F.lit(1)).alias("times"))
    # The writer sorts what a task holds by capture: in the session's partitions that is little.
    held = dealt(sums, "l_partkey").join(
        dealt(listed, "p_partkey").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey")
    )
    captures = ", ".join(
        f"struct(DATE'{day}' AS snapshot_date, TIMESTAMP_NTZ'{day} 00:00:00' AS balance_date, "
        f"200.0D + moved_{i} * times + IF(l_partkey % 11 = 0, {-7.0 * i}D, 0.0D) "
        f"+ IF(l_partkey % 13 = 0, {320.0 if i == 1 else 0.0}D, 0.0D) "
        f"+ IF(l_partkey % 17 = 0, {(100.0 if i >= 1 else 0.0) - (30.0 if i >= 2 else 0.0)}D, 0.0D) AS quantity)"
        for i, day in enumerate(SNAPSHOT_DATES)
    )
    return (
        held.selectExpr(
            f"'{ledger.replace('movements', 'balance')}' AS dataset",
            f"{item} AS item_code",
            "p_name AS item_description",
            "r_name AS warehouse",
            f"{category} AS category",
            "l_partkey",
            "p_retailprice",
            f"inline(array({captures}))",
        )
        .withColumn("value", F.col("quantity") * F.col("p_retailprice"))
        .drop("p_retailprice")
    )


def _job_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work in progress at each capture: the jobs opened before it."""
    jobs = wip_job_table(spark, sf_dir).select(
        F.lit("wip_balance").alias("dataset"),
        F.col("Job No").alias("item_code"),
        F.lit("").alias("item_description"),
        F.col("Customer").alias("warehouse"),
        F.col("Priority").alias("category"),
        F.lit(None).cast("bigint").alias("l_partkey"),
        "Opened",
        F.explode(F.array(*[F.lit(day).cast("date") for day in SNAPSHOT_DATES])).alias("snapshot_date"),
        (F.col("Job Value") * F.col("Ratio") * 0.01).alias("quantity"),
        F.col("Job Value").alias("value"),
    )
    return (
        jobs.withColumn("balance_date", F.col("snapshot_date").cast("timestamp_ntz"))
        .where(F.col("Opened") < F.col("balance_date"))
        .drop("Opened")
    )


_STORED: dict[tuple[str, str], str] = {}


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot table of all three stores.

    A history is a stored table by nature, so it is derived and written once per application, into
    the checkpoint folder, partitioned as the engine's own snapshots are.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4()}"
        parts = [
            _captures(spark, sf_dir, "rm_movements"),
            _captures(spark, sf_dir, "fg_movements"),
            _job_captures(spark, sf_dir),
        ]
        reduce(DataFrame.unionByName, parts).write.partitionBy("dataset", "snapshot_date").parquet(path)
        captures_write(spark.read.schema(_HISTORY_SCHEMA).parquet(path), path)
        _STORED[key] = path
    return spark.read.schema(_HISTORY_SCHEMA).parquet(_STORED[key])


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of captures beside the history."""
    history(spark, sf_dir)
    return snapshot_captures(spark, _STORED[spark.sparkContext.applicationId, sf_dir])


_HISTORY_SCHEMA = (
    "item_code string, item_description string, warehouse string, category string, l_partkey bigint, "
    "balance_date timestamp_ntz, quantity double, value double, dataset string, snapshot_date date"
)


def snapshots(spark: SparkSession, sf_dir: str, ledger: str) -> DataFrame:
    """The stored captures of one ledger's stock."""
    return history(spark, sf_dir).where(F.col("dataset") == ledger.replace("movements", "balance"))


def dated_balances(spark: SparkSession, sf_dir: str, ledger: str) -> DataFrame:
    """All captures as one dated balance table, where parts divisible by 5 miss the third capture."""
    third = F.col("snapshot_date") == F.lit(SNAPSHOT_DATES[2]).cast("date")
    return snapshots(spark, sf_dir, ledger).where(~(third & (F.col("l_partkey") % 5 == 0))).drop("snapshot_date")


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished-goods stock as a spreadsheet export hands it over.

    Sizes are floats, every fifth size was taken for a date, and filler rows have no key.
    """
    row = F.col("l_orderkey")
    return _lines(spark, sf_dir, 1, 4).select(
        F.when(row % 19 != 0, F.concat(F.col("l_partkey").cast("string"), F.lit(" "))).alias("Style #"),
        F.when(row % 19 != 0, F.col("p_size").cast("double")).alias("Size"),
        F.col("p_name").alias("Product Desc"),
        F.when(row % 23 != 0, F.col("r_name")).alias("Warehouse"),
        F.when(row % 211 == 0, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("Units"),
        F.col("p_brand").alias("Product"),
        F.col("l_shipdate").alias("Shipped"),
    )


EXPORT = Dataset("fg_balance", "balance", FG_STOCK.columns | {"quantity": "Units"})


CATALOG_TYPES = ("varchar", "datetime", "decimal(18,2)", "date", "int", "timestamp_ntz", "double", "string")


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part list read as a schema catalog: eight parts make a table, each part is a column."""
    key = F.col("p_partkey")
    table = F.floor(key / 8).cast("bigint")

    def pick(number: Column, *choices: str) -> Column:
        return F.get(F.array(*map(F.lit, choices)), (number % len(choices)).cast("int"))

    return driver_table(spark, sf_dir, "part").select(
        F.concat(F.lit("s"), (table % 3).cast("string")).alias("table_schema"),
        F.concat(
            pick(table, "Finished", "RawMaterial", "WIP", "Fabric", "Customer"),
            pick(F.floor(table / 5), "Trans", "StockBalance", "MovementHistory", "SOH", "Codes", "Names", "List"),
            table.cast("string"),
        ).alias("table_name"),
        F.concat(
            pick(key * 7 + table, "ItemCode", "Descr", "Whse", "TransDate", "TransType", "Qty", "DocRef", "AsAtDate", "Store", "Quantity", "Notes"),
            F.col("p_size").cast("string"),
        ).alias("column_name"),
        pick(F.col("p_size"), *CATALOG_TYPES).alias("data_type"),
        (key % 8 + 1).cast("int").alias("ordinal"),
    )
