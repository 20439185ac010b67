"""Benchmark decontamination: windows of test items, found in documents and cut out or dropped.

Defined results: null or empty text has no words and no hits; an item without words has no windows; an
item shorter than a window is one window; repeated items count once by id, and an item without an id marks hits but is not
counted; repeated document rows are judged row by row; an empty benchmark hits nothing; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyledger.llm.text import NOT_ALNUM, ascii_lower, split_words, table

WINDOW = 13
# Most windows that travel inside the plan as a hash set (8 bytes each); beyond it, a shuffle join.
MAX_BROADCAST_WINDOWS = 50_000


def _key(length: int, at: str) -> str:
    """Hash of four words of a window: a cheap sieve before whole windows are compared."""
    spots = sorted({0, length // 3, 2 * length // 3, length - 1})
    return f"xxhash64({', '.join(f'get(_words, {at} + {k})' for k in spots)}, {length})"


def _gram(length: int, at: str) -> str:
    return f"array_join(slice(_words, {at} + 1, {length}), ' ')"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows as gram (words joined by spaces), length, key and the ids of their items."""
    words = benchmark.select("item_id", split_words(ascii_lower(F.col("text")), NOT_ALNUM).alias("_words"))
    sized = words.where(F.size("_words") > 0).withColumn("length", F.least(F.size("_words"), F.lit(window)))
    placed = sized.withColumn("at", F.explode(F.expr("sequence(0, size(_words) - length)")))
    key = F.coalesce(*(F.when(F.col("length") == n, F.expr(_key(n, "at"))) for n in range(1, window + 1)))
    return (
        placed.select(
            F.expr("array_join(slice(_words, at + 1, length), ' ')").alias("gram"), "length", key.alias("key"), "item_id"
        )
        .groupBy("gram", "length", "key")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    )


def scan_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    window: int = WINDOW,
    max_broadcast: int = MAX_BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document: the kept columns, n_words, hit_words (word positions from 0) and items (ids).

    A document's positions are sieved inside the row against the hash set, so that only candidates leave
    the row, and those are verified as whole windows. With more windows than max_broadcast there is no
    set: all windows of the documents are joined by shuffle. Give as keep only narrow columns.
    """
    windows = benchmark_windows(benchmark, window)
    found = windows.select("key", "length").limit(max_broadcast + 1).collect()
    small = len(found) <= max_broadcast
    lengths = sorted({r["length"] for r in found}) if small else range(1, window + 1)
    words = split_words(ascii_lower(F.col("text")), NOT_ALNUM)
    held = documents.select(*keep, words.alias("_words"))
    parts = ["CAST(array() AS array<struct<at: int, length: int, gram: string>>)"]
    for n in lengths:
        at = f"sequence(0, size(_words) - {n})"
        if small:
            keys = ", ".join(f"{k}L" for k in sorted({r["key"] for r in found if r["length"] == n}))
            at = f"filter({at}, at -> {_key(n, 'at')} IN ({keys}))"
        parts.append(
            f"CASE WHEN size(_words) >= {n} THEN"
            f" transform({at}, at -> struct(at AS at, {n} AS length, {_gram(n, 'at')} AS gram)) ELSE array() END"
        )
    candidates = held.select(
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        F.expr(f"concat({', '.join(parts)})").alias("_found"),
        F.monotonically_increasing_id().alias("_row"),
    )
    spread = candidates.select("_row", *keep, "n_words", F.explode_outer("_found").alias("_c"))
    known = windows.select(F.col("gram").alias("_gram"), "items")
    hits = spread.join(F.broadcast(known) if small else known, F.col("_c.gram") == F.col("_gram"), "left")
    hit = F.when(F.col("items").isNotNull(), F.expr("sequence(_c.at, _c.at + _c.length - 1)"))
    return (
        hits.groupBy("_row")
        .agg(
            *(F.first(c).alias(c) for c in keep),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(hit)))).alias("hit_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .drop("_row")
    )


def contaminated() -> Column:
    n_hit = F.size("hit_words")
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, action: str = "drop", **options) -> DataFrame:
    """The documents without contaminated ones ("drop"), or with every hit word cut out of the text ("cut").

    Hits meet their document again by id and hash of the text, so repeated rows are treated alike; the
    side that joins holds only documents with hits.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    hits = scan_hits(documents.withColumn("_key", key), benchmark, ["doc_id", "_key"], **options)
    wanted = contaminated() if action == "drop" else F.size("hit_words") > 0
    hits = hits.where(wanted).groupBy(F.col("doc_id").alias("_doc"), F.col("_key").alias("_hash"))
    hits = hits.agg(F.first("hit_words").alias("_hits"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (key == F.col("_hash"))
    if action == "drop":
        return documents.join(hits, same, "left_anti")
    if action != "cut":
        raise ValueError(f"unknown action: {action!r}")
    # The text is not lower-cased here: A-Z belong to words too.
    between = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"{between.replace('[', '[^')}+{between}*"), F.lit(0))
    lead = F.regexp_extract("text", f"^{between}*", 0)
    kept = F.array_join(F.filter(pieces, lambda _, i: ~F.array_contains("_hits", i)), "")
    joined = documents.join(hits, same, "left")
    return joined.withColumn(
        "text", F.when(F.col("_hits").isNull(), F.col("text")).otherwise(F.concat(lead, kept))
    ).drop("_doc", "_hash", "_hits")


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    hits = scan_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return hits.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
