"""The corpus pipeline: documents in, token ids of what is worth training on out.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
documents; the last returns token ids. Between stages the rows are written as Parquet and read again.

Defined results: null text has no letter, so the first stage drops it; rows with a null id are kept, and meet others as a
document of the largest id; rows that repeat id and text become one in the second stage; an empty table stays empty through
all stages; further columns of any name come back as they are, as operators see only doc_id and text under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyledger.llm import bpe, decontamination, langid, near_duplicates, suffix_dedup
from tallyledger.llm.text import table
from tallyledger.sources.scratch import written_once


def _set_apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with its further columns under reserved names, and the columns that bring their own names back."""
    reserved = {c: c if c in ("doc_id", "text") else f"_own_{k}" for k, c in enumerate(docs.columns)}
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    renamed = docs.select(*[x.alias(reserved[c]) for x, c in zip(quoted, docs.columns, strict=True)])
    return renamed, [F.col(reserved[c]).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near a language's centroids; without a letter, or far from all, they go."""
    apart, back = _set_apart(docs)
    told = langid.identify(apart, langid.fit(docs), tuple(apart.columns))
    return told.where(~F.col("rejected")).select(*back)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id; of repeated rows one."""
    classes = near_duplicates.similarity_classes(docs.select("doc_id", "text"))
    first = classes.where(F.col("class_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_first")).distinct()
    apart, back = _set_apart(docs)
    kept = apart.join(first, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    return kept.withColumn("_same", F.row_number().over(same)).where("_same = 1").select(*back)


def remove_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that stand earlier in the corpus; a text of which nothing stays goes."""
    apart, back = _set_apart(docs)
    cut = suffix_dedup.remove_repeats(apart, in_place=True)
    kept = cut.where((F.col("n_removed") == 0) | (F.length("text") > 0)).select(*back)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    apart, back = _set_apart(docs)
    return decontamination.clean_documents(apart, table(spark, sf_dir, "benchmark")).select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the text decoded from them."""
    return bpe.encode_documents(docs, bpe.public_vocabulary(), outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("suffix_dedup", remove_repeated_bytes),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

# Centroids, suffix arrays and BPE are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written_once(stage(spark, docs, sf_dir))
    return docs
