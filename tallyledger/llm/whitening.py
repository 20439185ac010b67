"""Whitening of embedding vectors: blockwise QR of the centred rows, then singular values of the small triangular factor.

Entries c become whole numbers x = floor(1024 c) + 100000, so that counts, sums and deviations are exact.

1. Tasks add up their vectors per dimension; Spark adds the tasks up.
2. A task reduces its centred rows, a block at a time, to one triangular factor. The factors are written once and merged
   FAN at a time until one is left; every one is as large as the dimension squared, whatever the table.
3. The driver takes the last factor: Householder reflections, the differential qd algorithm and twisted factorisations
   (module bidiagonal) give the components, which are the right singular vectors.
4. The rows are projected and written once; the covariance of what was written, taken by Spark, tells how far from the
   identity it is.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are left out, as are entries beyond
2 to the 40th, which the whole numbers have no room for. Vectors of another length than most (of equally frequent
lengths the smaller) are left out too. Repeated rows and null keys count row by row; extra columns are ignored; without usable
vectors there are no rows. Components are numbered by falling eigenvalue; tied ones get any basis of their space, the same
for all rows. Their sign makes the largest entry positive. Where an eigenvalue is zero to rounding, whitened is null. A
deviation that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyledger.llm.bidiagonal import right_vectors
from tallyledger.llm.text import ready_workers, table
from tallyledger.sources.scratch import written_once

SCALE, SHIFT = 1024, 100_000
# The largest entry, rows of a block of the QR, and triangular factors that one task merges.
LARGEST = float(1 << 40)
BLOCK_ROWS = 4096
FAN = 16


def whole_numbers(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows of a batch are usable, and for each length met (or the one given) the rows' numbers and vectors."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = column.flatten()
    values = np.asarray(pc.fill_null(flat, np.nan), np.float64)
    good = np.isfinite(values) & (np.abs(values) <= LARGEST)
    ends = np.cumsum(sizes)
    bad = np.concatenate((np.zeros(1, np.int64), np.cumsum(~good)))
    usable = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    wanted = np.unique(sizes[usable]).tolist() if dimension is None else [dimension]
    rows, vectors = [], []
    for d in wanted:
        at = np.flatnonzero(usable & (sizes == d))
        rows.append(at)
        place = (ends - sizes)[at][:, None] + np.arange(d)
        vectors.append(np.floor(SCALE * values[place]).astype(np.int64) + SHIFT)
    return rows, vectors


@dataclass(frozen=True)
class Whitening:
    """Number of vectors, sums of their whole numbers, eigenvalues of the covariance (falling) and the components in columns."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        total = float(self.eigenvalues.sum())
        return self.eigenvalues / total if total else np.zeros(len(self.eigenvalues))

    def scaled(self, vectors: np.ndarray) -> np.ndarray:
        """n x - S, exact: in longs where they have room, else in Python's integers."""
        largest = max(map(abs, self.sums), default=0)
        if len(vectors):
            largest = max(largest, self.n * int(np.abs(vectors).max()))
        kind = np.int64 if largest < 1 << 61 else object
        return vectors.astype(kind) * self.n - np.array(self.sums, kind)


def _columns(vectors: DataFrame, column: str) -> DataFrame:
    return vectors.select(vectors[column].cast("array<double>").alias("vector"))


def count_and_sums(vectors: DataFrame, column: str) -> tuple[int, tuple[int, ...]]:
    """Number of usable vectors of the most frequent length, and exact sums of their whole numbers per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows, x in zip(*whole_numbers(batch.column(0)), strict=True):
                d = x.shape[1]
                counts[d] = counts.get(d, 0) + len(rows)
                # High and low halves apart, so that no sum leaves its long.
                part = (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
                sums[d] = sums.get(d, 0) + part
        for d, n in counts.items():
            yield pa.RecordBatch.from_pydict({"d": [d] * (d + 1), "k": list(range(-1, d)), "s": [str(n), *map(str, sums[d])]})

    exact = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    added = written_once(_columns(vectors, column).mapInArrow(run, "d bigint, k bigint, s string").groupBy("d", "k").agg(exact))
    most = added.where("k = -1").orderBy(F.desc("s"), "d").limit(1).collect()
    if not most:
        return 0, ()
    rows = added.where((F.col("d") == most[0].d) & (F.col("k") >= 0)).orderBy("k").collect()
    return int(most[0].s), tuple(int(r.s) for r in rows)


def triangular_factor(vectors: DataFrame, column: str, model: Whitening) -> np.ndarray:
    """R of the QR factorisation of all centred vectors."""
    d = len(model.sums)

    def reduced(block: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(block, mode="r")
        return r if len(r) == d else np.vstack((r, np.zeros((d - len(r), d))))

    def packed(part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros((0, d))], 0
        for batch in batches:
            _, (x,) = whole_numbers(batch.column(0), d)
            held.append(model.scaled(x).astype(np.float64) / model.n)
            size += len(x)
            if size >= BLOCK_ROWS:
                held, size = [reduced(np.vstack(held))], 0
        yield packed(TaskContext.get().partitionId(), reduced(np.vstack(held)))

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        order = rows.sort_by("part")
        blocks = [np.frombuffer(b, np.float64).reshape(d, d) for b in order.column("r").to_pylist()]
        return pa.Table.from_batches([packed(key[0].as_py(), reduced(np.vstack(blocks)))])

    factors = written_once(_columns(vectors, column).mapInArrow(run, "part bigint, r binary"))
    last = factors.agg(F.max("part")).first()[0]
    while last:
        factors = factors.groupBy(F.floor(F.col("part") / FAN).alias("next")).applyInArrow(merge, "part bigint, r binary")
        last //= FAN
    rows = factors.collect()
    return np.frombuffer(bytes(rows[0].r), np.float64).reshape(d, d) if rows else np.zeros((d, d))


def fit(vectors: DataFrame, column: str = "embedding", components: int = 8) -> Whitening:
    ready_workers(vectors.sparkSession)
    n, sums = count_and_sums(vectors, column)
    model = Whitening(n, sums, np.zeros(len(sums)), np.zeros((len(sums), 0)))
    if not n:
        return model
    squares, right = right_vectors(triangular_factor(vectors, column, model), components)
    right = right * np.where(right[np.abs(right).argmax(0), np.arange(right.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, squares / n, right)


def transform(vectors: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, deviation and whitened (an array over the components) of every usable vector."""
    ready_workers(vectors.sparkSession)
    schema = f"`{key}` {vectors.schema[key].dataType.simpleString()}, deviation bigint, whitened array<double>"
    values = model.eigenvalues[: model.components.shape[1]]
    rounding = len(model.sums) * np.finfo(np.float64).eps
    real = values > rounding**2 * values.max(initial=0.0)
    scale = np.where(real, 1.0 / np.sqrt(np.where(real, values, 1.0)), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (rows,), (x,) = whole_numbers(batch.column(0), len(model.sums))
            scaled = model.scaled(x)
            large = len(x) and (scaled.dtype == object or float(np.square(scaled.astype(np.float64)).sum(1).max()) > 2.0**62)
            exact = scaled.astype(object) if large else scaled
            deviation = [s if s < 1 << 63 else None for s in (exact * exact).sum(1).tolist()]
            white = scaled.astype(np.float64) / model.n @ model.components * scale
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(pa.array(rows)),
                    pa.array(deviation, pa.int64()),
                    pa.array([[None if np.isnan(w) else w for w in r] for r in white.tolist()], pa.list_(pa.float64())),
                ],
                [key, "deviation", "whitened"],
            )

    rows = vectors.select(vectors[column].cast("array<double>").alias("vector"), vectors[key].alias("key"))
    return rows.mapInArrow(run, schema) if model.n else vectors.sparkSession.createDataFrame([], schema)


def identity_error(whitened: DataFrame, components: int, column: str = "whitened") -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity; null without components."""
    pairs = list(combinations_with_replacement(range(components), 2))
    entry = [F.abs(F.covar_pop(F.col(column)[i], F.col(column)[j]) - F.lit(float(i == j))).alias(f"c{i}_{j}") for i, j in pairs]
    found = [c for c in whitened.agg(*entry).first() if c is not None] if pairs else []
    return max(found, default=None)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = fit(vectors, components=8)
    whitened = written_once(transform(vectors, model))
    many = model.components.shape[1]
    explained = F.array(*[F.lit(float(x)) for x in model.explained[:many]]).cast("array<double>")
    each = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("k")].alias("explained"),
        F.lit(identity_error(whitened, many)).cast("double").alias("identity_error"),
    )
