"""Host-level quality rules: rule failures per host, shrunk towards all hosts, decide about its documents.

Defined results: null or empty text has no words and fails the base rule; a null host is one host of its
own; repeated rows are judged row by row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyledger.llm.text import SPACE, split_words

WINDOW = 5
# Rules counted per host: name -> share of failing documents, after shrinking, from which the host is out.
HOST_LIMITS = {"thin": 0.6, "repeats": 0.6, "symbols": 0.6, "duplicate_lines": 0.6}
SYMBOLS = r"[^#*$%&|<>]+"


def text_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """The input's rows with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Everything is computed inside the row: window hashes are sorted per document, never shuffled.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    line_has_word = lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0
    first = documents.withColumns(
        {
            "_words": split_words(F.col(text), SPACE),
            "_lines": F.filter(F.split(whole, "\n"), line_has_word),
            "n_symbols": F.length(F.regexp_replace(whole, SYMBOLS, "")).cast("bigint"),
        }
    )
    later = ", ".join(f"get(_words, i + {k})" for k in range(1, WINDOW))
    hashes = F.expr(
        f"transform(slice(_words, 1, greatest(size(_words) - {WINDOW - 1}, 0)), (w, i) -> xxhash64(w, {later}))"
    )
    counted = first.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_hashes": hashes,
        }
    )
    repeats = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    placed = counted.withColumn(
        "_placed",
        F.when(repeats, F.expr("sort_array(transform(_hashes, (h, i) -> struct(h AS h, i AS i)))")),
    )
    twice = placed.withColumn(
        "_twice",
        F.expr(
            "sort_array(transform(filter(_placed, (p, k) -> p.h <=> get(_placed, k - 1).h OR p.h <=> get(_placed, k + 1).h),"
            " p -> p.i))"
        ),
    )
    covered = F.expr(
        f"aggregate(transform(_twice, (p, k) -> least({WINDOW}, coalesce(get(_twice, k + 1) - p, {WINDOW}))), 0L,"
        " (a, x) -> a + x)"
    )
    return twice.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop(
        "_words", "_lines", "_hashes", "_placed", "_twice"
    )


def base_failure() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failures() -> dict[str, Column]:
    """Each document rule as a boolean over the statistics."""
    return {
        "thin": F.col("n_words") < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "duplicate_lines": 5 * F.col("n_dup_lines") > F.col("n_words"),
    }


def host_verdicts(judged: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate per rule, and host_ok.

    The prior is a beta distribution matched to mean and variance of the hosts' rates (binomial noise
    taken off); a host with few documents moves towards the mean of all. Counts combine before the shuffle, so a hot
    host is one row per task.
    """
    rules = list(HOST_LIMITS)
    fails = rule_failures()
    counts = judged.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *(F.sum(fails[r].cast("bigint")).alias(f"n_{r}") for r in rules),
    )
    n = F.col("n_docs").cast("double")
    moments = []
    for r in rules:
        rate = F.col(f"n_{r}") / n
        moments += [
            (F.sum(f"n_{r}") / F.sum(n)).alias(f"m_{r}"),
            F.var_pop(rate).alias(f"v_{r}"),
            F.avg(rate * (1 - rate) / n).alias(f"e_{r}"),
        ]
    prior = counts.agg(*moments)
    with_prior = counts.join(F.broadcast(prior))  # one row
    shrunk, ok = {}, F.lit(True)
    for r in rules:
        mean = F.col(f"m_{r}")
        between = F.greatest(F.col(f"v_{r}") - F.col(f"e_{r}"), F.lit(1e-6))
        weight = F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0))
        shrunk[f"rate_{r}"] = (F.col(f"n_{r}") + mean * weight) / (n + weight)
        ok = ok & (shrunk[f"rate_{r}"] < HOST_LIMITS[r])
    return with_prior.select("host", "n_docs", *(c.alias(k) for k, c in shrunk.items()), ok.alias("host_ok"))


def apply_quality_rules(documents: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The input's rows with their statistics, base_failed, host_ok and kept.

    The host table has one row per host; Spark broadcasts it by its measured size or splits hot hosts of
    a shuffle join.
    """
    judged = text_statistics(documents, text).withColumn("base_failed", base_failure())
    verdicts = host_verdicts(judged, host).select(F.col("host").alias("_host"), "host_ok")
    return (
        judged.join(verdicts, F.col(host).eqNullSafe(F.col("_host")), "left")
        .drop("_host")
        .withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
    )


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return apply_quality_rules(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
