"""The reports a stock controller runs, each from physical tables to results.

An `Inventory` ties physical tables to their mappings and rules. Every report returns lazy
DataFrames by name; write them with `result_sink`, or explain them with the narratives included.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..config import Dataset, LedgerRules
from ..functions.vocabulary import BALANCE_OF, SCOPES
from ..operators import anomalies, balances, chain, cube, flow, movements, narrative, reconcile, summaries
from ..operators.movements import is_excluded
from ..sources import baseline, canonical, snapshots
from ..sources.canonical import Moment

_STORES = ("rm_balance", "fg_balance", "wip_balance")


@dataclass(frozen=True)
class Inventory:
    datasets: Mapping[str, Dataset]
    tables: Mapping[str, DataFrame]
    rules: LedgerRules = field(default_factory=LedgerRules)

    # ---- reading ----

    def fetch(self, dataset: str, **filters) -> DataFrame:
        """Canonical rows of one dataset; filters as in `canonical_scan`."""
        return canonical.canonical_scan(self.tables[dataset], self.datasets[dataset], **filters)

    def ledger(self, scope: str = "all", **filters) -> DataFrame:
        return canonical.ledger_union({name: self.fetch(name, **filters) for name in SCOPES[scope]}, scope)

    def live(self, now: Moment) -> DataFrame:
        """Current balances of the three stores, tagged by dataset."""
        first, *rest = [
            self.fetch(name, as_of=now).withColumn("dataset", F.lit(name)) for name in _STORES
        ]
        for store in rest:
            first = first.unionByName(store, allowMissingColumns=True)
        return first

    # ---- reports ----

    def summary(
        self,
        scope: str,
        date_from: Moment,
        date_to: Moment,
        freq: str = "MS",
        item: str | None = None,
        warehouse: str | None = None,
    ) -> dict[str, DataFrame]:
        """Receipts, issues, adjustments and net per item, warehouse and period, with a narrative."""
        rows = self.ledger(scope, date_from=date_from, date_to=date_to, item_code=item, warehouse=warehouse)
        result = summaries.movement_summary(rows, self.rules, freq, ordered=True)
        return {"summary": result, "explanation": narrative.explain_summary(result)}

    def reconcile(
        self,
        scope: str,
        *,
        opening: DataFrame | None = None,
        closing: DataFrame | None = None,
        date_from: Moment | None = None,
        date_to: Moment | None = None,
        now: Moment | None = None,
        item: str | None = None,
        warehouse: str | None = None,
    ) -> dict[str, DataFrame]:
        """Opening plus movements against closing for one store.

        With an opening snapshot the closing is a second snapshot or live stock at `now`; without
        one the balance table must carry dates. Item and warehouse filter all three legs alike.
        """
        if scope not in ("fg", "rm"):
            raise ValueError("reconcile works per store: choose fg or rm")
        if closing is not None and opening is None:
            raise ValueError("a closing snapshot needs an opening snapshot")
        ledger_name = SCOPES[scope][0]
        store = self.datasets[BALANCE_OF[ledger_name]]
        only = {"item_code": item, "warehouse": warehouse}
        moved = self.ledger(scope, **only)
        if opening is not None:
            live = closing is None
            end = self.fetch(store.name, as_of=now or date_to, **only) if live else closing
            result = reconcile.reconcile_snapshots(
                _filtered(opening, item, warehouse),
                moved,
                end if live else _filtered(end, item, warehouse),
                self.rules,
                live=live,
                date_from=date_from,
                date_to=date_to,
                now=now,
                ordered=True,
            )
            start, stop = reconcile.window_bounds(opening, closing, date_from, date_to, now)
        elif store.has_date:
            if date_from is None or date_to is None:
                raise ValueError("date_from and date_to are required without an opening snapshot")
            result = reconcile.reconcile_dated(
                self.fetch(store.name, date_to=date_to, **only), moved, self.rules, date_from, date_to, ordered=True
            )
            start, stop = date_from, date_to
        else:
            raise ValueError(
                f"{store.name} is a current-state balance without history: capture a snapshot and pass it as opening"
            )
        inside = canonical.in_window(moved, F.col("movement_date"), start, stop)
        return {
            "reconciliation": result,
            "excluded": movements.exclusion_totals(inside, self.rules).where("excluded"),
            "explanation": narrative.explain_reconciliation(result),
        }

    def reconcile_chain(self, scope: str, captured: DataFrame) -> dict[str, DataFrame]:
        """Every interval between consecutive snapshots, and the kind of variance each key shows.

        `captured` holds the snapshots of this store with their `snapshot_date`.
        """
        if scope not in ("fg", "rm"):
            raise ValueError("reconcile_chain works per store: choose fg or rm")
        tolerance = self.rules.variance_tolerance
        periods = chain.reconcile_chain(self.ledger(scope), captured, self.rules)
        classified = chain.chain_classify(periods, tolerance, ordered=True)
        return {
            "periods": periods,
            "period_stats": chain.chain_period_stats(periods, tolerance),
            "report": chain.chain_report(classified),
            "counts": chain.chain_class_counts(classified),
        }

    def report(self, date_from: Moment, date_to: Moment, history: DataFrame) -> dict[str, DataFrame]:
        """Movements by category of both ledgers, and opening against closing of all stores."""
        breakdowns = {
            f"{scope}_by_category": summaries.category_summary(
                self.fetch(SCOPES[scope][0], date_from=date_from, date_to=date_to), self.rules
            )
            for scope in ("rm", "fg")
        }
        return breakdowns | {
            "balances": balances.stock_balances_report(history, self.live(date_to), date_from)
        }

    def dashboard(self, date_from: Moment, date_to: Moment, history: DataFrame) -> dict[str, DataFrame]:
        """Daily category totals of both ledgers, balance points of all stores, and their check."""
        cubes, orders = {}, {}
        for scope in ("rm", "fg"):
            moved = self.fetch(SCOPES[scope][0], date_from=date_from, date_to=date_to)
            cubes[scope] = cube.category_day_cube(moved, self.rules).withColumn("ledger", F.lit(scope))
            orders[scope] = cube.category_order(moved, self.rules).withColumn("ledger", F.lit(scope))
        daily = cubes["rm"].unionByName(cubes["fg"])
        points = balances.balance_points(history, self.live(date_to), date_to)
        return {
            "movements": daily,
            "categories": orders["rm"].unionByName(orders["fg"]),
            "baselines": points,
            "reconciliation": cube.store_reconciliation(points, daily, date_from, date_to, (date_from, date_to)),
        }

    def flow(
        self,
        scope: str,
        date_from: Moment,
        date_to: Moment,
        measure: str = "value",
        warehouse: str | None = None,
    ) -> dict[str, DataFrame]:
        """The stock-flow graph: links, nodes, node totals and components."""
        rows = self.ledger(scope, date_from=date_from, date_to=date_to, warehouse=warehouse)
        links = flow.flow_links(flow.flow_contributions(rows, self.rules, measure))
        return {
            "links": links,
            "nodes": flow.flow_nodes(links),
            "node_totals": flow.flow_node_totals(links),
            "components": flow.flow_components(rows, measure),
        }

    def anomalies(
        self,
        scope: str,
        date_from: Moment,
        date_to: Moment,
        item: str | None = None,
        warehouse: str | None = None,
    ) -> dict[str, DataFrame]:
        """Negative balances, outlier movements and dormant items up to `date_to`."""
        only = {"item_code": item, "warehouse": warehouse}
        rows = self.ledger(scope, date_from=date_from, date_to=date_to, **only)
        held = None
        for name in SCOPES[scope]:
            store = self.datasets[BALANCE_OF[name]]
            fetched = self.fetch(store.name, date_to=date_to, as_of=date_to, **only).select(*anomalies.BALANCE_COLUMNS)
            balance = (
                balances.snapshot_asof(fetched, date_to) if store.has_date else balances.snapshot_current(fetched)
            )
            held = balance if held is None else held.unionByName(balance)
        found = anomalies.anomalies(rows, held, self.rules, as_of=date_to)
        return {"anomalies": found, "explanation": narrative.explain_anomalies(found)}

    def snapshot(self, dataset: str, now: Moment, warehouse: str | None = None) -> DataFrame:
        """Balance per item and warehouse: as of `now` if the table has dates, else current."""
        ds = self.datasets[dataset]
        if ds.kind != "balance":
            raise ValueError(f"{dataset} is not a balance dataset")
        rows = self.fetch(dataset, as_of=now, warehouse=warehouse)
        if ds.has_date:
            return balances.snapshot_asof(rows, now, ordered=True)
        return balances.snapshot_current(rows, ordered=True)

    def snapshot_all(self, path: str, now: Moment, stamp: Moment | None = None) -> DataFrame:
        """Capture the three stores under one date stamp; rows, quantity and value per store."""
        spark = self.tables[_STORES[0]].sparkSession
        stamp = now if stamp is None else stamp
        snapshots.snapshot_write({name: self.fetch(name, as_of=now) for name in _STORES}, path, stamp)
        captured = snapshots.snapshot_table(spark, path)
        day = F.to_date(canonical.at(stamp))
        return snapshots.snapshot_write_summary(captured.where(F.col("snapshot_date") == day))

    def types(self, scope: str, date_from: Moment | None = None, date_to: Moment | None = None) -> DataFrame:
        """Movement types in use, most frequent first per ledger."""
        return summaries.movement_types(self.ledger(scope, date_from=date_from, date_to=date_to))

    def movements(
        self,
        scope: str,
        date_from: Moment,
        date_to: Moment,
        item: str | None = None,
        warehouse: str | None = None,
    ) -> dict[str, DataFrame]:
        """Every transaction of a window, and its net."""
        rows = self.ledger(scope, date_from=date_from, date_to=date_to, item_code=item, warehouse=warehouse)
        return {"movements": movements.movement_drilldown(rows), "totals": movements.drilldown_totals(rows)}

    def import_baseline(self, exports: dict[str, DataFrame], as_of: Moment) -> dict[str, DataFrame]:
        """Baselines from the sheets of a stock export."""
        return baseline.baseline_imports(exports, dict(self.datasets), as_of)

    def kept(self, rows: DataFrame) -> DataFrame:
        """Movements that count in a reconciliation."""
        return rows.where(~is_excluded(self.rules))


def _filtered(balance: DataFrame, item: str | None, warehouse: str | None) -> DataFrame:
    if item:
        balance = balance.where(F.col("item_code") == item)
    if warehouse:
        balance = balance.where(F.col("warehouse") == warehouse)
    return balance
