"""Language identification: nearest of several TF-IDF centroids per language, with rejection by distance.

Fitted on a bounded sample of labelled rows: of each of the MOST_LANGUAGES languages with the most rows (equal numbers by
name) at most SAMPLE_PER_LANGUAGE different rows. Predicts from the text alone. Defined results: null text, or text
without a letter, is `und` with score 0 and rejected; without labelled rows everything is `und`; a null label is
not learned; repeated rows are learned once and predicted row by row; texts of any length are read whole; of centroids
equally near the first counts, by name of the language; an empty table gives no rows; extra columns are ignored, and a
column to keep that has the name of a result gives way to it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyledger.llm.text import fold_of, ready_workers, table

# Hashed letter pairs and triples; word ends count as a letter.
DIMENSIONS = 8192
CENTROIDS = 4
# The bound of the sample: labelled rows per language, and languages.
SAMPLE_PER_LANGUAGE = 400
MOST_LANGUAGES = 400
# A text is rejected if its cosine is below this share of the least that its language met in the sample.
REJECT_SHARE = 0.5
# A cluster holds this share of its language's sample at least, so that no stray text is a centroid of its own.
LEAST_CLUSTER = 0.02
RESULTS = ("lang_pred", "score", "rejected")
_STARTS, _RENEWALS, _SALTS = 4, 8, 64
_PIECE = 1 << 20


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Counts of hashed letter pairs and triples of the whole text; None without a letter."""
    counts, any_letter, letters = np.zeros(dimensions, np.int64), False, _letters()
    for k in range(0, max(len(text), 1), _PIECE):
        points = np.frombuffer(text[k : k + _PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = letters[points]
        if not letter.any():
            continue
        any_letter = True
        kept = letter.copy()
        kept[1:] |= letter[:-1]  # one mark for each run of other characters
        codes = np.concatenate(([0], np.where(letter, points, 0)[kept], [0])).astype(np.uint64)
        pairs = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        triples = pairs[:-1] * np.uint64(0x165667B19E3779F9) + codes[2:] * np.uint64(0x27D4EB2F165667C5)
        hashed = np.concatenate((pairs * np.uint64(0x9E3779B97F4A7C15), triples * np.uint64(0xC2B2AE3D27D4EB4F)))
        counts += np.bincount((hashed >> np.uint64(40)).astype(np.int64) % dimensions, minlength=dimensions)
    return counts if any_letter else None


@dataclass(frozen=True)
class CentroidModel:
    """Unit centroids (rows), their languages, the least cosine each accepts, and the weights of features."""

    languages: list[str]
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid, rejected."""
        counts = ngram_counts(text) if text else None
        if counts is None or not self.languages:
            return "und", 0.0, True
        vector = np.log1p(counts).astype(np.float32) * self.idf
        norm = float(np.sqrt(vector @ vector))
        cosines = self.centroids @ vector / np.float32(norm or 1.0)
        best = int(cosines.argmax())
        score = min(max(float(cosines[best]), 0.0), 1.0)
        return self.languages[best], score, score < float(self.least[best])


def _spread(vectors: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starts of k-means: each next one drawn by its distance from those chosen."""
    chosen = [int(rng.integers(len(vectors)))]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < k:
        far = np.maximum(1 - near.astype(np.float64), 0)
        far[far < 1e-6] = 0
        if not far.any():
            break
        chosen.append(int(rng.choice(len(vectors), p=far / far.sum())))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    return vectors[chosen].copy()


def _settled(vectors: np.ndarray, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Rounds of spherical k-means; gives the sizes of the clusters."""
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(1)
        for c in range(len(centroids)):
            if (nearest == c).any():
                total = vectors[nearest == c].sum(0)
                centroids[c] = total / (np.sqrt(total @ total) or 1.0)
    return np.bincount((vectors @ centroids.T).argmax(1), minlength=len(centroids))


def _clustered(vectors: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """The best of some starts of spherical k-means, without clusters below the least size.

    A centroid with too few rows starts anew from a row of the largest cluster; one that ends so all the same is given up.
    """
    least = LEAST_CLUSTER * len(vectors)
    rng, found = np.random.default_rng(len(vectors)), []
    for _ in range(_STARTS):
        centroids = _spread(vectors, min(k, len(vectors)), rng)
        sizes = _settled(vectors, centroids, rounds)
        for _ in range(_RENEWALS):
            if (sizes >= least).all():
                break
            largest = np.flatnonzero((vectors @ centroids.T).argmax(1) == sizes.argmax())
            for c in np.flatnonzero(sizes < least):
                centroids[c] = vectors[rng.choice(largest)]
            sizes = _settled(vectors, centroids, rounds)
        while len(centroids) > 1 and (sizes < least).any():
            centroids = np.delete(centroids, sizes.argmin(), 0)
            sizes = _settled(vectors, centroids, rounds)
        found.append((len(centroids), float((vectors @ centroids.T).max(1).sum()), centroids))
    return max(found, key=lambda x: x[:2])[2]


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> CentroidModel:
    """A model from rows with doc_id, text and lang.

    Per language the rows with the least hash of their id are taken, `per_language` of them at most, rows that repeat id and
    text as one; their features, not their texts, reach the driver: 16 KB a row. Rows are ranked by parts of a language
    first, so that no task ranks a whole one.
    """
    ready_workers(labelled.sparkSession)
    rows = labelled.select("doc_id", "lang", "text").where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("key", F.xxhash64("text"))
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    ids = rows.select("lang", "doc_id", "key").distinct().join(F.broadcast(most.select("lang")), "lang", "left_semi")
    ids = ids.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(_SALTS)))
    for part in (("lang", "salt"), ("lang",)):
        order = Window.partitionBy(*part).orderBy(F.xxhash64("doc_id"), "doc_id", "key")
        ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).drop("n")
    ids = ids.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("key") == F.col("_key"))
    sample = rows.join(F.broadcast(ids), same, "left_semi")
    sample = sample.groupBy("lang", "doc_id", "key").agg(F.any_value("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                counts = ngram_counts(batch.column("text")[k].as_py())
                if counts is not None:
                    # Half precision of the logarithm is ample, and keeps a row small.
                    data = pa.array([np.log1p(counts).astype(np.float16).tobytes()], pa.binary())
                    columns = [batch.column("lang").slice(k, 1), batch.column("doc_id").slice(k, 1).cast(pa.string()), data]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "id", "data"])

    found = sample.mapInArrow(run, "lang string, id string, data binary").collect()
    found.sort(key=lambda r: (r["lang"], r["id"] or "", bytes(r["data"])))
    if not found:
        return CentroidModel([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), np.ones(DIMENSIONS, np.float32))
    names = np.array([r["lang"] for r in found])
    # One matrix, filled and scaled row by row: the driver holds no second one.
    vectors, met = np.empty((len(found), DIMENSIONS), np.float32), np.zeros(DIMENSIONS, np.int64)
    for k, row in enumerate(found):
        vectors[k] = np.frombuffer(row["data"], np.float16)
        met += vectors[k] > 0
    del found
    idf = (np.log((1 + len(vectors)) / (1 + met)) + 1).astype(np.float32)
    for vector in vectors:
        vector *= idf
        vector /= np.maximum(np.sqrt((vector * vector).sum(keepdims=True)), 1e-9)
    languages, centroids, least = [], [], []
    for language in sorted(set(names.tolist())):
        own = vectors[names == language]
        centres = _clustered(own, CENTROIDS)
        languages += [language] * len(centres)
        centroids += list(centres)
        least += [REJECT_SHARE * float((own @ centres.T).max(1).min())] * len(centres)
    return CentroidModel(languages, np.stack(centroids), np.array(least), idf)


def identify(documents: DataFrame, model: CentroidModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score and rejected. The broadcast model is 128 KB a language."""
    spark = documents.sparkSession
    keep = tuple(c for c in keep if c.lower() not in RESULTS)
    ready_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    columns = documents.select(*dict.fromkeys((*keep, "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            made = [model.predict(x.as_py()) for x in batch.column("text")]
            kinds = ((0, pa.string()), (1, pa.float64()), (2, pa.bool_()))
            arrays = [pa.array([m[k] for m in made], kind) for k, kind in kinds]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *arrays], [*keep, *RESULTS]
            )

    return columns.mapInArrow(run, f"{kept}, lang_pred string, score double, rejected boolean")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = fit(documents.where(~held_out))
    return identify(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
