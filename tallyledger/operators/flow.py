"""How stock flows from vendors through raw stores, production and finished stores to customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import LedgerRules
from ..functions.numbers import exact_total, rounded
from ..functions.vocabulary import (
    CUSTOMERS,
    DIRECT_SALES,
    FG_PREFIX,
    HUB_COLUMNS,
    INTERNAL_TYPES,
    PRODUCTION,
    RETURNED_TO_VENDOR,
    RM_PREFIX,
    ROLE_COLUMNS,
    VENDORS,
)
from .movements import classify_direction

MEASURES = ("value", "units")

# Links lighter than this are dust.
MIN_WEIGHT = 0.5


def _edge(source: str | Column, target: str | Column, sign: int | Column = 1) -> Column:
    def column(given: str | int | Column) -> Column:
        return given if isinstance(given, Column) else F.lit(given)

    return F.struct(
        column(source).alias("source"), column(target).alias("target"), column(sign).cast("int").alias("sign")
    )


def route() -> Column:
    """Edge (source, target, sign) of a movement, or null if it never leaves its store."""
    kind, quantity = F.col("movement_type"), F.col("quantity")
    raw = F.col("dataset") == "rm_movements"
    store = F.concat(F.when(raw, RM_PREFIX).otherwise(FG_PREFIX), F.col("warehouse"))
    # A cancellation is a reversal when it books stock back in.
    reversal = F.when(quantity > 0, -1).otherwise(1)
    side = F.when(raw, "(RM)").otherwise("(FG)")
    raw_edge = (
        F.when(kind == "RECEIPT", _edge(VENDORS, store))
        .when(kind == "DESPATCH", _edge(store, PRODUCTION))
        .when(kind == "CANCELLED DESPATCH", _edge(store, PRODUCTION, reversal))
        .when(kind == "RETURN", _edge(store, PRODUCTION, -1))
        .when(kind == "SALE STOCK", _edge(store, DIRECT_SALES))
        .when(kind == "RTV", _edge(store, RETURNED_TO_VENDOR))
    )
    finished_edge = (
        F.when(kind == "RECEIVED", _edge(PRODUCTION, store))
        .when(kind.isin("INVOICED", "PICKED"), _edge(store, CUSTOMERS))
        .when(kind == "RETURNED", _edge(store, CUSTOMERS, -1))
        .when(kind.startswith("DESPATCH CANCELLED"), _edge(store, CUSTOMERS, reversal))
    )
    adjustment = F.when(
        F.col("direction") == "adjustment",
        F.when(quantity > 0, _edge(F.concat(F.lit("Adj in "), side), store)).otherwise(
            _edge(store, F.concat(F.lit("Adj out "), side))
        ),
    )
    return F.when(
        ~kind.isin(*INTERNAL_TYPES), F.coalesce(F.when(raw, raw_edge).otherwise(finished_edge), adjustment)
    )


def flow_route(movements: DataFrame, rules: LedgerRules) -> DataFrame:
    """Movements with `source`, `target` and `sign`; outside the graph no ends and sign 0."""
    return (
        classify_direction(movements, rules)
        .withColumn("edge", route())
        .select(
            *movements.columns,
            "direction",
            "edge.source",
            "edge.target",
            F.coalesce("edge.sign", F.lit(0)).alias("sign"),
        )
    )


def _weights(movements: DataFrame, measure: str) -> DataFrame:
    """Add `units` and `money`, the sizes a movement counts with."""
    if measure not in MEASURES:
        raise ValueError(f"measure must be one of {MEASURES}, not {measure!r}")
    money = F.abs("value") if measure == "value" and "value" in movements.columns else F.lit(0.0)
    return movements.withColumn("units", F.abs("quantity")).withColumn("money", money)


def _by_money() -> Column:
    """True if any movement carries money; decided over the few aggregated rows, not in a job."""
    return F.sum("gross_money").over(Window.partitionBy()) > 0


def flow_contributions(movements: DataFrame, rules: LedgerRules, measure: str = "value") -> DataFrame:
    """Signed weight and units per edge, weighed by value or, where there is none, by units.

    One scan adds up both measures; unrouted movements stay as an edge without ends until the
    choice is made. Edges number a handful per store, which bounds the window that makes it.
    """
    sign = F.col("sign")
    edges = (
        flow_route(_weights(movements, measure), rules)
        .groupBy("source", "target")
        .agg(
            exact_total(F.col("money") * sign).alias("money"),
            exact_total(F.col("units") * sign).alias("units"),
            exact_total(F.col("money")).alias("gross_money"),
        )
        .withColumn("by_money", _by_money())
    )
    return edges.where(F.col("source").isNotNull()).select(
        "source",
        "target",
        F.when(F.col("by_money"), F.col("money")).otherwise(F.col("units")).alias("weight"),
        "units",
        F.when(F.col("by_money"), "value").otherwise("units").alias("measure"),
    )


def flow_links(contributions: DataFrame) -> DataFrame:
    """Net opposing edges against each other, point each link the way stock moved, drop dust."""
    forward = F.col("source") <= F.col("target")
    sign = F.when(forward, 1).otherwise(-1)
    pairs = contributions.groupBy(
        F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high"), "measure"
    ).agg(
        exact_total(F.col("weight") * sign).alias("weight"),
        exact_total(F.col("units") * sign).alias("units"),
    )
    ahead = F.col("weight") > 0
    return pairs.where(F.abs("weight") > MIN_WEIGHT).select(
        F.when(ahead, F.col("low")).otherwise(F.col("high")).alias("source"),
        F.when(ahead, F.col("high")).otherwise(F.col("low")).alias("target"),
        rounded(F.abs("weight"), 2).alias("weight"),
        rounded(F.abs("units"), 1).alias("units"),
        "measure",
    )


def flow_nodes(links: DataFrame) -> DataFrame:
    """Ends of the links with their role and column in the left-to-right layout."""
    name = F.col("name")
    role = (
        F.when(name == VENDORS, "vendors")
        .when(name == PRODUCTION, "production")
        .when(name == CUSTOMERS, "customers")
        .when(name.isin(*HUB_COLUMNS), "hub")
        .when(name.startswith(RM_PREFIX), "rm_store")
        .otherwise("fg_store")
    )
    place = F.col("role")
    column = None
    for given, number in HUB_COLUMNS.items():
        column = F.when(name == given, number) if column is None else column.when(name == given, number)
    for given, number in ROLE_COLUMNS.items():
        column = column.when(place == given, number)
    return (
        links.select(F.explode(F.array("source", "target")).alias("name"))
        .distinct()
        .withColumn("role", role)
        .withColumn("column", column)
    )


def flow_node_totals(links: DataFrame) -> DataFrame:
    """Weight in, out and through every node."""
    ends = links.select(
        F.inline(
            F.array(
                F.struct(F.col("source").alias("name"), F.lit(0.0).alias("inward"), F.col("weight").alias("outward")),
                F.struct(F.col("target").alias("name"), F.col("weight").alias("inward"), F.lit(0.0).alias("outward")),
            )
        )
    )
    return (
        ends.groupBy("name")
        .agg(exact_total(F.col("inward")).alias("inward"), exact_total(F.col("outward")).alias("outward"))
        .withColumn("total", F.greatest("inward", "outward"))
    )


def flow_components(movements: DataFrame, measure: str = "value", ordered: bool = True) -> DataFrame:
    """Rows, units and gross weight per ledger and movement type, transfers included."""
    components = (
        _weights(movements, measure)
        .groupBy("dataset", "movement_type")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            exact_total(F.col("quantity")).alias("units"),
            exact_total(F.col("money")).alias("gross_money"),
            exact_total(F.col("units")).alias("gross_units"),
        )
        .withColumn("by_money", _by_money())
        .select(
            "dataset",
            "movement_type",
            "rows",
            "units",
            F.when(F.col("by_money"), F.col("gross_money")).otherwise(F.col("gross_units")).alias("value"),
        )
    )
    return components.orderBy(F.col("value").desc(), "dataset", "movement_type") if ordered else components
