"""Results in plain sentences, as rows (line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as words
from ..functions.cells import strip
from ..functions.numbers import exact_total, grouped_text, signed_text
from ..functions.reuse import dealt, shared
from ..functions.vocabulary import KEY


def _item(df: DataFrame) -> Column:
    place = F.concat(F.lit(" in "), F.col("warehouse"))
    if "item_description" not in df.columns:
        return F.concat("item_code", place)
    description = strip(F.coalesce("item_description", F.lit("")))
    return F.concat(
        "item_code", F.when(description == "", "").otherwise(F.concat(F.lit(" ("), description, F.lit(")"))), place
    )


def _numbered(top: DataFrame, line: Column, *order: Column | str) -> DataFrame:
    """Lines of a short, already limited frame, numbered from 1 in the given order."""
    listed = top.select(F.struct(*order, line.alias("line")).alias("entry"))
    return (
        listed.agg(F.sort_array(F.collect_list("entry")).alias("entries"))
        .select(F.posexplode("entries").alias("place", "entry"))
        .select((F.col("place") + 1).alias("line_no"), "entry.line")
    )


def _headline(totals: DataFrame, rows: str, sentence: Column, empty: str) -> DataFrame:
    return totals.select(
        F.lit(0).alias("line_no"), F.when(F.col(rows) == 0, empty).otherwise(sentence).alias("line")
    )


_TOTALS = ("receipt", "issue", "adjustment", "net")


def _per_key(summary: DataFrame) -> DataFrame:
    """Totals per key over all periods. Rows of the summary are dealt out as they are: added up where they come from, the sums
    would lie in one task beside those that the summary itself is made of."""
    rows = dealt(summary.select(*KEY, *_TOTALS), *KEY)
    return shared(rows.groupBy(*KEY).agg(*[exact_total(F.col(name)).alias(name) for name in _TOTALS]))


def explain_summary_numbers(summary: DataFrame) -> DataFrame:
    """The totals behind the first sentence of a movement summary."""
    return _summary_numbers(_per_key(summary))


def _summary_numbers(per_key: DataFrame) -> DataFrame:
    """Totals from one reading of the keys; each part of the key is counted in a small aggregate of its own, as several
    distinct counts at once would copy every row."""
    totals = per_key.agg(F.count(F.lit(1)).alias("rows"), *[exact_total(F.col(name)).alias(name) for name in _TOTALS])
    for name, key in (("items", "item_code"), ("warehouses", "warehouse")):
        count = per_key.select(key).distinct().agg(F.count(key).alias(name))
        totals = totals.unionByName(count, allowMissingColumns=True)
    return totals.agg(*[F.max(name).alias(name) for name in ("rows", "items", "warehouses", *_TOTALS)])



def top_movers(summary: DataFrame, top_n: int = 10) -> DataFrame:
    """Items and warehouses with the largest net change over all periods."""
    return _movers(_per_key(summary), top_n)


def _movers(per_key: DataFrame, top_n: int) -> DataFrame:
    return per_key.select(*KEY, "net").orderBy(F.abs("net").desc(), *KEY).limit(top_n)


def explain_summary(summary: DataFrame, top_n: int = 10) -> DataFrame:
    per_key = _per_key(summary)
    totals = _summary_numbers(per_key)
    headline = F.format_string(
        words.SUMMARY_TOTALS,
        F.col("items").cast("string"),
        F.col("warehouses").cast("string"),
        grouped_text(F.col("receipt"), 0),
        grouped_text(F.abs("issue"), 0),
        signed_text(F.col("adjustment"), 0),
        signed_text(F.col("net"), 0),
    )
    movers = _movers(per_key, top_n)
    # The reference label of a mover is its code, shown as item and as description.
    labelled = movers.withColumn("item_description", F.col("item_code"))
    line = F.format_string(
        words.SUMMARY_MOVER,
        _item(labelled),
        F.when(F.col("net") > 0, "built up").otherwise("drew down"),
        grouped_text(F.abs("net"), 0),
    )
    return _headline(totals, "rows", headline, words.NO_MOVEMENTS).unionByName(
        _numbered(labelled, line, (-F.abs("net")).alias("size"), *KEY)
    )


def explain_reconciliation_numbers(rec: DataFrame) -> DataFrame:
    """How many keys were reconciled and how many do not balance."""
    return rec.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("within_tolerance").alias("balanced"),
        F.count_if(~F.col("within_tolerance")).alias("unexplained"),
    )


def explain_reconciliation(rec: DataFrame, top_n: int = 10) -> DataFrame:
    rec = shared(rec)
    totals = explain_reconciliation_numbers(rec)
    headline = F.format_string(
        words.RECONCILED_TOTALS, *[F.col(name).cast("string") for name in ("rows", "balanced", "unexplained")]
    )
    worst = (
        rec.where(~F.col("within_tolerance")).orderBy(F.abs("variance").desc(), *KEY).limit(top_n)
    )
    line = F.format_string(
        words.RECONCILED_ROW,
        _item(worst),
        grouped_text(F.col("closing_qty"), 1),
        grouped_text(F.col("opening_qty"), 1),
        signed_text(F.col("net_movement"), 1),
        grouped_text(F.col("expected_closing"), 1),
        grouped_text(F.abs("variance"), 1),
        F.when(F.col("variance") > 0, "more").otherwise("less"),
    )
    return _headline(totals, "rows", headline, words.NOTHING_TO_RECONCILE).unionByName(
        _numbered(worst, line, (-F.abs("variance")).alias("size"), *KEY)
    )


# Findings are told kind by kind, in this order.
_KINDS = ("negative_balance", "outlier_movement", "dormant_item")


def _kind_place() -> Column:
    place = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("kind"))
    return F.when(place == 0, len(_KINDS) + 1).otherwise(place)


def top_findings(findings: DataFrame, top_n: int = 20) -> DataFrame:
    """The first findings: by kind, then by item, warehouse and detail."""
    return findings.withColumn("place", _kind_place()).orderBy("place", *KEY, "detail").limit(top_n)


def explain_anomalies(findings: DataFrame, top_n: int = 20) -> DataFrame:
    columns = [name for name in ("kind", *KEY, "item_description", "detail") if name in findings.columns]
    # Dealt out once: both readers ask for all columns of that exchange, so that findings are not looked for twice.
    findings = findings.select(*columns).repartition(*columns)
    first = top_findings(findings, top_n)
    item, detail = _item(first), F.col("detail")
    line = None
    for kind, sentence in words.ANOMALY_SENTENCES.items():
        told = F.format_string(sentence, item, detail)
        line = F.when(F.col("kind") == kind, told) if line is None else line.when(F.col("kind") == kind, told)
    line = line.otherwise(F.format_string(words.ANOMALY_FALLBACK, item, detail))
    rest = F.col("rows") - top_n
    # Either the sentence for no findings, or what is left beyond the first ones, or nothing.
    closing = (
        shared(findings.agg(F.count(F.lit(1)).alias("rows"), F.max(F.hash(*columns)).alias("seen")))
        .select(
            F.lit(top_n + 1).alias("line_no"),
            F.when(F.col("rows") == 0, words.NO_ANOMALIES)
            .when(rest > 0, F.format_string(words.ANOMALY_REST, rest.cast("string")))
            .alias("line"),
        )
        .where(F.col("line").isNotNull())
    )
    return _numbered(first, line, "place", *KEY, "detail").unionByName(closing)
