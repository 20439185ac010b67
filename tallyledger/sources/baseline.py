"""Import of stock-export rows as a baseline balance."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, functions as F

from ..config import Dataset
from ..functions.cells import (
    non_blank,
    number_or_zero,
    quoted,
    repaired_key,
    strip,
    tighten_separator,
    type_of,
)
from ..functions.numbers import part_sums, total_of_parts
from ..functions.vocabulary import EXPORT_SHEETS, KEY
from .canonical import Moment, at


def baseline_import(export: DataFrame, ds: Dataset, as_of: Moment) -> DataFrame:
    """One baseline row per item and warehouse from the rows of a stock export.

    Key cells are repaired, filler rows without a key are dropped, a blank warehouse becomes '-'.
    Exclusions and value do not apply to an import.
    """
    canonical = ["item_code", "item_description", "warehouse", "quantity"]
    if ds.columns.get("category") is not None:
        canonical.append("category")
    for name in canonical:
        _require(export, ds, name)
    texts = [name for name in ("item_description", "category") if name in canonical]

    rows = export.select(
        tighten_separator(_text(export, ds, "item_code")).alias("item_code"),
        F.coalesce(non_blank(_text(export, ds, "warehouse")), F.lit("-")).alias("warehouse"),
        *[_text(export, ds, name).alias(name) for name in texts],
        _number(export, ds, "quantity").alias("quantity"),
    ).where(strip(F.replace("item_code", F.lit("|"), F.lit(""))) != "")

    # Numbers combine by hash per key and texts; only what is left is sorted to pick a text.
    combined = rows.groupBy(*KEY, *[non_blank(F.col(name)).alias(name) for name in texts]).agg(*part_sums("quantity"))
    baseline = combined.groupBy(*KEY).agg(
        *[F.coalesce(F.min(name), F.lit("")).alias(name) for name in texts], total_of_parts("quantity").alias("quantity")
    )
    order = [*KEY, "balance_date", "item_description", "quantity", *texts[1:]]
    return baseline.withColumn("balance_date", at(as_of)).select(*order)


def baseline_imports(
    exports: dict[str, DataFrame], datasets: dict[str, Dataset], as_of: Moment
) -> dict[str, DataFrame]:
    """Baselines for the sheets of an export that are known, keyed by balance dataset."""
    known = {sheet: name for sheet, name in EXPORT_SHEETS.items() if sheet in exports}
    if not known:
        raise ValueError(f"no known sheets in {sorted(exports)}; expected any of {list(EXPORT_SHEETS)}")
    return {name: baseline_import(exports[sheet], datasets[name], as_of) for sheet, name in known.items()}


def _require(export: DataFrame, ds: Dataset, canonical: str) -> None:
    mapping = ds.columns[canonical]
    if isinstance(mapping, dict):
        needed = [factor for factor in mapping["product"] if isinstance(factor, str)]
    else:
        needed = mapping if isinstance(mapping, list) else [mapping] if mapping else []
    absent = [name for name in needed if name not in export.columns]
    if absent:
        raise KeyError(f"{ds.name}.{canonical}: export lacks columns {absent}")


def _text(export: DataFrame, ds: Dataset, canonical: str) -> Column:
    mapping = ds.columns[canonical]
    if mapping is None:
        return F.lit("")
    if isinstance(mapping, list):  # an empty part keeps its place in the key, unlike in a scan
        cells = [repaired_key(quoted(name), type_of(export, name)) for name in mapping]
        return strip(F.concat_ws("|", *cells))
    return repaired_key(quoted(mapping), type_of(export, mapping))


def _number(export: DataFrame, ds: Dataset, canonical: str) -> Column:
    mapping = ds.columns[canonical]
    if isinstance(mapping, dict):
        return reduce(
            mul,
            [
                number_or_zero(quoted(factor), type_of(export, factor))
                if isinstance(factor, str)
                else F.lit(float(factor))
                for factor in mapping["product"]
            ],
        )
    return number_or_zero(quoted(mapping), type_of(export, mapping))
