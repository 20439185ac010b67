import math

import numpy as np
import pytest

from tallyledger.llm import whitening
from tallyledger.llm.bidiagonal import bidiagonalise, right_vectors, squared_values
from tallyledger.llm.whitening import fit, identity_error, op12_embedding_whitening, transform

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def reflections(matrix):
    """The bidiagonal matrix with the reflections from the right put back, which has the same product with itself."""
    diagonal, above, right = bidiagonalise(matrix)
    b = np.diag(diagonal) + np.diag(above, 1)
    for k in range(len(right) - 1, -1, -1):
        v, beta = right[k]
        b[:, k + 1 :] -= np.outer(b[:, k + 1 :] @ v, beta * v)
    return b


def matrices():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    yield from (rng.standard_normal((n, n)) for n in (1, 2, 3, 17, 64))
    yield np.eye(9)
    yield np.zeros((4, 4))
    yield np.ones((12, 12))
    yield np.diag([3.0, 3, 2, 2, 1, 0])
    yield q * np.array([1.0] * 20 + [2.0] * 20) @ q.T
    yield q * (1 + 1e-9 * np.arange(40)) @ q.T
    yield q * (10.0 ** -np.arange(40)) @ q.T
    yield np.linalg.qr(np.vstack([rng.standard_normal((5, 40)), np.zeros((40, 40))]), mode="r")


@pytest.mark.parametrize("k", range(len(list(matrices()))))
def test_values_and_vectors(k):
    a = list(matrices())[k]
    n = len(a)
    size = max(float(np.linalg.norm(a, 2)) ** 2, 1e-300)
    assert np.allclose(reflections(a).T @ reflections(a), a.T @ a, atol=1e-13 * size)
    values, vectors = right_vectors(a)
    assert np.allclose(values, np.linalg.svd(a, compute_uv=False) ** 2, rtol=1e-12, atol=1e-14 * size)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-11
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max() <= 1e-13 * size


def test_small_values_keep_their_digits():
    diagonal, above = 10.0 ** -np.arange(12.0), 0.5 * 10.0 ** -np.arange(11.0)
    from fractions import Fraction as Fr

    # The product of all squared values is the squared determinant, to the last digits even of the smallest.
    found = squared_values(diagonal, above)
    exact = math.prod(Fr(float(x)) ** 2 for x in diagonal)
    assert abs(math.prod(Fr(float(v)) for v in found) / exact - 1) < 1e-13
    assert len(found) == 12 and (found > 0).all()


def brute(rows):
    kept = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], np.int64)
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True))) for r in x]
    return [i for i, _ in kept], n, deviation, centred @ vectors / np.sqrt(np.maximum(values, 1e-30)), values / values.sum()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    data = rng.standard_normal((700, 12)) @ rng.standard_normal((12, 12)) * 0.1
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(data)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(300)]
    rows += [(None, rows[6][1], 1), (None, rows[6][1], 1)]
    rows += [(2000, None, 0), (2001, [None] * 12, 0), (2002, [float("nan")] * 12, 0), (2003, [1.0] * 11 + [float("-inf")], 0), (2004, [], 0), (2005, [0.5] * 11, 0)]
    return rows


def test_against_eigenvectors(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 32)
    monkeypatch.setattr(whitening, "FAN", 2)
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = op12_embedding_whitening(spark, str(tmp_path))
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = df.collect()
    ids, n, deviation, white, explained = brute([(i, v) for i, v, _ in rows if v is None or len(v) != 11])
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    own = {(r.vec_id, r.component): r for r in got}
    for c in range(1, 9):
        sign = np.sign(own[0, c].whitened * white[0][c - 1])
        for k, i in enumerate(ids):
            r = own[i, c]
            assert math.isclose(r.whitened, sign * white[k][c - 1], rel_tol=1e-7, abs_tol=1e-8)
            assert r.deviation == deviation[k]
            assert math.isclose(r.explained, explained[c - 1], rel_tol=1e-9)
    assert sum(r.vec_id is None for r in got) == 16


def test_few_dimensions_rank_and_empty(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    flat = make([(i, [float(i % 5), 0.25, 2.0 * (i % 5)], 0) for i in range(20)])
    model = fit(flat)
    assert model.components.shape == (3, 3) and np.allclose(model.explained, [1, 0, 0], atol=1e-12)
    white = transform(flat, model)
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in white.collect())
    assert identity_error(white, 3) < 1e-9
    same = make([(1, [0.5, 0.5], 0)] * 3)
    model = fit(same)
    assert model.n == 3 and [tuple(r) for r in transform(same, model).collect()] == [(1, 0, [None, None])] * 3
    for empty in (make([]), make([(1, None, 0), (2, [float("nan")], 0)])):
        model = fit(empty)
        assert model.n == 0 and transform(empty, model).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(2**38) * (k % 3), float(k)], 0) for k in range(9)] + [(9, [float(2**41), 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, deviation int")
    model = fit(df)
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v, _ in rows[:9]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert (model.n, list(model.sums)) == (9, sums)
    exact = {k: sum((9 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for k, v in enumerate(x)}
    got = {r.vec_id: r.deviation for r in transform(df, model).collect()}
    assert got == {k: e if e < 1 << 63 else None for k, e in exact.items()} and None in got.values()
