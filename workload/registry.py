"""One query per operator, each over the driver's whole tables."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyledger.functions.cells import repaired_key, type_of
from tallyledger.operators import (
    anomalies,
    balances,
    chain,
    cube,
    discovery,
    flow,
    movements,
    narrative,
    reconcile,
    summaries,
)
from tallyledger.sources import baseline, canonical, physical, snapshots
from tallyledger.sources.scratch import checkpoint_folder

from . import tables
from .tables import RULES

Query = Callable[[SparkSession, str], DataFrame]

WINDOW = ("1998-01-01", "2000-01-01")
FIRST, SECOND, THIRD, FOURTH = tables.SNAPSHOT_DATES
POSITIVE_RULES = dataclasses.replace(RULES, issues_stored_positive=True)


# ---- inputs ------------------------------------------------------------------------------------


def fg(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
    return canonical.canonical_scan(tables.fg_ledger_table(spark, sf_dir), tables.FG_LEDGER, **filters)


def rm(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
    return canonical.canonical_scan(tables.rm_ledger_table(spark, sf_dir), tables.RM_LEDGER, **filters)


def ledger(spark: SparkSession, sf_dir: str, scope: str = "all", **filters) -> DataFrame:
    frames = {"fg_movements": fg(spark, sf_dir, **filters), "rm_movements": rm(spark, sf_dir, **filters)}
    return canonical.ledger_union(frames, scope)


def stock(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Current-state balances of the three stores, canonical, one row per lot."""
    physical_tables = {
        "rm_balance": tables.rm_stock_table(spark, sf_dir),
        "fg_balance": tables.fg_stock_table(spark, sf_dir),
        "wip_balance": tables.wip_job_table(spark, sf_dir),
    }
    return {
        name: canonical.canonical_scan(table, tables.DATASETS[name], as_of=tables.READ_AT)
        for name, table in physical_tables.items()
    }


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, *rest = [df.withColumn("dataset", F.lit(name)) for name, df in stock(spark, sf_dir).items()]
    for df in rest:
        first = first.unionByName(df)
    return first


def capture(spark: SparkSession, sf_dir: str, day: str, name: str = "fg_movements") -> DataFrame:
    return tables.snapshots(spark, sf_dir, name).where(F.col("snapshot_date") == F.lit(day).cast("date"))


def scratch(spark: SparkSession) -> str:
    """A new folder inside the checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4()}"


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, so that any two engines compare them alike."""

    def column(field: T.StructField):
        if isinstance(field.dataType, T.DateType):
            return F.date_format(field.name, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            return F.date_format(field.name, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        return F.col(f"`{field.name}`")

    return df.select(*[column(field) for field in df.schema.fields])


# ---- queries -----------------------------------------------------------------------------------

_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    _REGISTRY[function.__name__] = lambda spark, sf_dir: plain(function(spark, sf_dir))
    return function


@query
def canonical_scan(spark, sf_dir):
    ds = tables.FG_STOCK
    return canonical.project(tables.fg_stock_table(spark, sf_dir), ds).drop("balance_date")


@query
def date_window(spark, sf_dir):
    return fg(spark, sf_dir, date_from=WINDOW[0], date_to=WINDOW[1])


@query
def item_filter(spark, sf_dir):
    return ledger(spark, sf_dir, item_code="RM7")


@query
def item_filter_composite(spark, sf_dir):
    """A key of two numbers, which reaches the scan as conditions on both."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey = 7").select("p_size").first()
    return ledger(spark, sf_dir, item_code=f"7|{part.p_size}")


@query
def warehouse_filter(spark, sf_dir):
    return ledger(spark, sf_dir, warehouse="ASIA")


@query
def exclude_where(spark, sf_dir):
    table = canonical.without_excluded(tables.rm_stock_table(spark, sf_dir), tables.RM_STOCK)
    return canonical.project(table, tables.RM_STOCK).drop("balance_date")


@query
def normalize_movements(spark, sf_dir):
    return canonical.canonical_scan(tables.untidy_ledger_table(spark, sf_dir), tables.UNTIDY_LEDGER)


@query
def normalize_balances(spark, sf_dir):
    return stock(spark, sf_dir)["wip_balance"]


@query
def ledger_union(spark, sf_dir):
    return ledger(spark, sf_dir)


@query
def snapshot_csv_load(spark, sf_dir):
    """Write the current stock as CSV files, load them back, total them per key."""
    path = scratch(spark)
    physical.result_sink(balances.snapshot_current(stock(spark, sf_dir)["fg_balance"]), path)
    return snapshots.snapshot_csv_load(spark, path).select(
        "item_code", "warehouse", "item_description", "balance_date", "quantity", "value", "category"
    )


@query
def snapshot_write(spark, sf_dir):
    path = scratch(spark)
    snapshots.snapshot_write(stock(spark, sf_dir), path, FOURTH)
    snapshots.snapshot_write(stock(spark, sf_dir), path, FOURTH)  # a rerun replaces its own capture
    return snapshots.snapshot_write_summary(snapshots.snapshot_table(spark, path))


@query
def snapshot_history(spark, sf_dir):
    return snapshots.snapshot_history(tables.captures(spark, sf_dir))


@query
def snapshot_files(spark, sf_dir):
    """File names derived from the days orders were placed; every third is not a snapshot name."""
    names = tables.driver_table(spark, sf_dir, "orders").select(
        F.concat(
            F.when(F.col("o_orderkey") % 3 == 0, "fg_balance_x").otherwise("fg_balance_"),
            F.date_format("o_orderdate", "yyyyMMdd"),
            F.when(F.col("o_orderkey") % 2 == 0, "_late.csv").otherwise(".csv"),
        ).alias("file_name")
    )
    return snapshots.snapshot_files(names, "fg_balance")


@query
def baseline_asof(spark, sf_dir):
    captures = tables.captures(spark, sf_dir)
    requests = balances.store_frame(captures).select("dataset", F.lit("1998-09-01").cast("date").alias("as_of"))
    return balances.baseline_asof(captures, requests)


@query
def baseline_asof_join(spark, sf_dir):
    """The baseline in force on every day a ledger moved."""
    days = (
        ledger(spark, sf_dir)
        .select(F.replace("dataset", F.lit("movements"), F.lit("balance")).alias("dataset"), F.to_date("movement_date").alias("as_of"))
        .distinct()
    )
    return balances.baseline_asof(tables.captures(spark, sf_dir), days)


@query
def balance_before(spark, sf_dir):
    """Every finished-goods movement beside the balance last captured for its item and warehouse."""
    moved = fg(spark, sf_dir).select("item_code", "warehouse", "movement_date", "movement_type", "quantity", "reference")
    return balances.balance_before(moved, tables.snapshots(spark, sf_dir, "fg_movements"))


@query
def baseline_import(spark, sf_dir):
    return baseline.baseline_import(tables.export_rows(spark, sf_dir), tables.EXPORT, "2001-12-01")


@query
def key_cell_repair(spark, sf_dir):
    rows = tables.export_rows(spark, sf_dir)
    return rows.select(
        *[
            repaired_key(F.col(f"`{name}`"), type_of(rows, name)).alias(alias)
            for name, alias in (("Style #", "style"), ("Size", "size"), ("Shipped", "shipped"), ("Warehouse", "store"))
        ]
    )


@query
def classify_direction(spark, sf_dir):
    return movements.classify_direction(ledger(spark, sf_dir), RULES)


@query
def signed_quantity(spark, sf_dir):
    return movements.signed_quantity(ledger(spark, sf_dir), POSITIVE_RULES)


@query
def signed_value(spark, sf_dir):
    return movements.signed_value(ledger(spark, sf_dir), POSITIVE_RULES)


@query
def apply_exclusions(spark, sf_dir):
    kept, excluded = movements.apply_exclusions(ledger(spark, sf_dir), RULES)
    return kept.withColumn("excluded", F.lit(False)).unionByName(excluded.withColumn("excluded", F.lit(True)))


@query
def exclusion_totals(spark, sf_dir):
    return movements.exclusion_totals(ledger(spark, sf_dir), RULES)


@query
def movement_drilldown(spark, sf_dir):
    return movements.movement_drilldown(ledger(spark, sf_dir, date_from=WINDOW[0], date_to=WINDOW[1]))


@query
def drilldown_totals(spark, sf_dir):
    return movements.drilldown_totals(ledger(spark, sf_dir, date_from=WINDOW[0], date_to=WINDOW[1]))


@query
def flow_route(spark, sf_dir):
    return flow.flow_route(ledger(spark, sf_dir), RULES)


@query
def movement_summary(spark, sf_dir):
    return summaries.movement_summary(ledger(spark, sf_dir), RULES)


@query
def movement_summary_buckets(spark, sf_dir):
    """Rules with a bucket of their own show it without being asked."""
    returns = dict(RULES.movement_types) | {"returns": ["RETURN", "RETURNED"]}
    return summaries.movement_summary(ledger(spark, sf_dir), dataclasses.replace(RULES, movement_types=returns))


@query
def movement_summary_weekly(spark, sf_dir):
    return summaries.movement_summary(ledger(spark, sf_dir), POSITIVE_RULES, freq="W")


@query
def movement_summary_daily(spark, sf_dir):
    return summaries.movement_summary(ledger(spark, sf_dir, "rm"), RULES, freq="D")


@query
def category_summary(spark, sf_dir):
    return summaries.category_summary(ledger(spark, sf_dir), RULES)


@query
def movement_types(spark, sf_dir):
    return summaries.movement_types(ledger(spark, sf_dir))


@query
def movement_net(spark, sf_dir):
    return summaries.movement_net(ledger(spark, sf_dir), POSITIVE_RULES)


@query
def snapshot_current(spark, sf_dir):
    return balances.snapshot_current(stock(spark, sf_dir)["fg_balance"])


@query
def snapshot_asof(spark, sf_dir):
    return balances.snapshot_asof(tables.dated_balances(spark, sf_dir, "fg_movements"), "1999-03-01")


@query
def stock_balances_report(spark, sf_dir):
    return balances.stock_balances_report(tables.captures(spark, sf_dir), live(spark, sf_dir), "1998-09-01")


@query
def balance_points(spark, sf_dir):
    return balances.balance_points(tables.captures(spark, sf_dir), live(spark, sf_dir), "2001-12-01")


def _cube(spark, sf_dir, top=20):
    parts = [
        cube.category_day_cube(df, RULES, top).withColumn("ledger", F.lit(tag))
        for tag, df in (("rm", rm(spark, sf_dir)), ("fg", fg(spark, sf_dir)))
    ]
    return parts[0].unionByName(parts[1])


@query
def category_day_cube(spark, sf_dir):
    return _cube(spark, sf_dir)


@query
def category_day_cube_folded(spark, sf_dir):
    return cube.category_day_cube(fg(spark, sf_dir), POSITIVE_RULES, top=5)


@query
def category_rank_topn(spark, sf_dir):
    return cube.category_rank_topn(fg(spark, sf_dir), RULES)


@query
def category_order(spark, sf_dir):
    return cube.category_order(fg(spark, sf_dir), RULES, top=7)


@query
def window_category_net(spark, sf_dir):
    return cube.window_category_net(cube.category_day_cube(fg(spark, sf_dir), RULES), WINDOW[1], WINDOW[0], "value")


@query
def store_reconciliation(spark, sf_dir):
    points = balances.balance_points(tables.captures(spark, sf_dir), live(spark, sf_dir), "2001-12-01")
    return cube.store_reconciliation(points, _cube(spark, sf_dir), "1998-02-01", "1999-02-01", ("1998-01-01", "2001-12-01"))


@query
def reconcile_snapshots(spark, sf_dir):
    return reconcile.reconcile_snapshots(
        capture(spark, sf_dir, SECOND), fg(spark, sf_dir), capture(spark, sf_dir, THIRD), RULES
    )


@query
def reconcile_live(spark, sf_dir):
    return reconcile.reconcile_snapshots(
        capture(spark, sf_dir, FOURTH, "rm_movements"),
        rm(spark, sf_dir),
        stock(spark, sf_dir)["rm_balance"],
        RULES,
        live=True,
        now=tables.READ_AT,
    )


@query
def reconcile_dated(spark, sf_dir):
    return reconcile.reconcile_dated(
        tables.dated_balances(spark, sf_dir, "fg_movements"), fg(spark, sf_dir), RULES, SECOND, "1999-03-01"
    )


@query
def reconcile_window(spark, sf_dir):
    return reconcile.reconcile_window(capture(spark, sf_dir, SECOND), capture(spark, sf_dir, THIRD))


_REGISTRY["reconcile"] = lambda spark, sf_dir: plain(
    reconcile.reconcile(capture(spark, sf_dir, FIRST), fg(spark, sf_dir), capture(spark, sf_dir, FOURTH), POSITIVE_RULES)
)


@query
def item_description_lookup(spark, sf_dir):
    return reconcile.item_description_lookup(
        capture(spark, sf_dir, FIRST), stock(spark, sf_dir)["rm_balance"], ledger(spark, sf_dir)
    )


def _chain(spark, sf_dir, name="fg_movements"):
    ledgers = {"fg_movements": fg, "rm_movements": rm}
    return chain.reconcile_chain(ledgers[name](spark, sf_dir), tables.snapshots(spark, sf_dir, name), RULES)


LABELS = [
    f"{start}->{end}".replace("-", "").replace(">", "->")
    for start, end in zip(tables.SNAPSHOT_DATES, tables.SNAPSHOT_DATES[1:])
]


@query
def reconcile_chain(spark, sf_dir):
    return _chain(spark, sf_dir)


@query
def chain_from_files(spark, sf_dir):
    """The same chain from dated CSV files: every capture is written as one and loaded back."""
    folder = scratch(spark)
    paths = []
    for day in tables.SNAPSHOT_DATES:
        paths.append(f"{folder}/fg_balance_{day.replace('-', '')}.csv")
        physical.result_sink(capture(spark, sf_dir, day).drop("dataset", "snapshot_date", "l_partkey"), paths[-1])
    return chain.reconcile_chain(fg(spark, sf_dir), snapshots.snapshot_csv_load(spark, paths), RULES)


@query
def chain_classify(spark, sf_dir):
    return chain.chain_classify(_chain(spark, sf_dir), RULES.variance_tolerance)


@query
def chain_classify_rm(spark, sf_dir):
    return chain.chain_classify(_chain(spark, sf_dir, "rm_movements"), RULES.variance_tolerance)


@query
def chain_wide(spark, sf_dir):
    return chain.chain_wide(_chain(spark, sf_dir), LABELS)


@query
def chain_class_counts(spark, sf_dir):
    return chain.chain_class_counts(chain.chain_classify(_chain(spark, sf_dir), RULES.variance_tolerance))


@query
def chain_period_stats(spark, sf_dir):
    return chain.chain_period_stats(_chain(spark, sf_dir), RULES.variance_tolerance)


@query
def negative_balance(spark, sf_dir):
    return anomalies.negative_balance(tables.dated_balances(spark, sf_dir, "fg_movements"))


@query
def robust_stats(spark, sf_dir):
    return anomalies.robust_stats(ledger(spark, sf_dir))


@query
def robust_stats_split(spark, sf_dir):
    """The same statistics over quantities below one, where slices of the value range must split too."""
    rows = ledger(spark, sf_dir)
    return anomalies.robust_stats(rows.withColumn("quantity", F.col("quantity") / 1024))


@query
def outlier_movements(spark, sf_dir):
    return anomalies.outlier_movements(ledger(spark, sf_dir), RULES)


@query
def dormant_items(spark, sf_dir):
    return anomalies.dormant_items(ledger(spark, sf_dir), RULES)


def _findings(spark, sf_dir):
    dated = tables.dated_balances(spark, sf_dir, "fg_movements").unionByName(
        tables.dated_balances(spark, sf_dir, "rm_movements")
    )
    held = dated.select(*anomalies.BALANCE_COLUMNS)
    return anomalies.anomalies(ledger(spark, sf_dir), balances.snapshot_asof(held, READ_DAY), RULES, READ_DAY)


READ_DAY = "2001-12-01"

_REGISTRY["anomalies"] = lambda spark, sf_dir: plain(_findings(spark, sf_dir))


@query
def flow_contributions(spark, sf_dir):
    return flow.flow_contributions(ledger(spark, sf_dir), RULES)


@query
def flow_contributions_units(spark, sf_dir):
    return flow.flow_contributions(ledger(spark, sf_dir).withColumn("value", F.lit(0.0)), RULES)


def _links(spark, sf_dir):
    return flow.flow_links(flow.flow_contributions(ledger(spark, sf_dir), RULES))


@query
def flow_links(spark, sf_dir):
    return _links(spark, sf_dir)


@query
def flow_nodes(spark, sf_dir):
    return flow.flow_nodes(_links(spark, sf_dir))


@query
def flow_node_totals(spark, sf_dir):
    return flow.flow_node_totals(_links(spark, sf_dir))


@query
def flow_components(spark, sf_dir):
    return flow.flow_components(ledger(spark, sf_dir))


@query
def explain_summary(spark, sf_dir):
    return narrative.explain_summary(summaries.movement_summary(ledger(spark, sf_dir), RULES))


@query
def explain_reconciliation(spark, sf_dir):
    return narrative.explain_reconciliation(
        reconcile.reconcile_snapshots(
            capture(spark, sf_dir, SECOND), fg(spark, sf_dir), capture(spark, sf_dir, THIRD), RULES
        )
    )


@query
def explain_anomalies(spark, sf_dir):
    return narrative.explain_anomalies(_findings(spark, sf_dir))


@query
def discover_table_scores(spark, sf_dir):
    return discovery.discover_table_scores(tables.part_catalog(spark, sf_dir))


@query
def discover_columns(spark, sf_dir):
    return discovery.discover_columns(tables.part_catalog(spark, sf_dir))


@query
def discover_datasets(spark, sf_dir):
    return discovery.discover_datasets(tables.part_catalog(spark, sf_dir))


@query
def discovery_gaps(spark, sf_dir):
    return discovery.discovery_gaps(discovery.discover_datasets(tables.part_catalog(spark, sf_dir)))


@query
def list_columns(spark, sf_dir):
    return discovery.list_columns(tables.part_catalog(spark, sf_dir), ["FinishedTrans0", "WIPStockBalance7", "FabricTrans3"])


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)
