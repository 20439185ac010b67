"""Inventory ledger analytics as Spark DataFrame operators."""

from .config import Dataset, LedgerRules

__all__ = ["Dataset", "LedgerRules"]
