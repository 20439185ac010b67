"""Singular values and right singular vectors of a small square matrix by way of its bidiagonal form.

Householder reflections make the matrix bidiagonal; the differential qd algorithm with shifts finds the squares of its
singular values, each with small relative error; a factorisation twisted where it nearly breaks down gives the vector of
each. Values that lie close together share an inverse iteration that keeps their vectors at right angles. Everything here
is the size of a vector's dimension, not of a table.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
_TINY = float(np.finfo(np.float64).tiny)
# Values nearer to each other than this part of their size are a cluster.
CLUSTER = 1e-3


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, beta and the first entry left, so that x - beta * v * (v @ x) has zeros behind its first entry."""
    norm = float(np.linalg.norm(x))
    v = x.copy()
    if norm == 0.0 or not np.any(x[1:]):
        return v, 0.0, float(x[0])
    left = -norm if x[0] >= 0 else norm
    v[0] -= left
    return v, 2.0 / float(v @ v), left


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """Diagonal, superdiagonal and the reflections from the right, of which the k-th acts on places from k + 1 on."""
    a = np.array(matrix, np.float64)
    n = a.shape[1]
    diagonal, above, right = np.zeros(n), np.zeros(max(n - 1, 0)), []
    for k in range(n):
        v, beta, diagonal[k] = _reflector(a[k:, k])
        if beta:
            a[k:, k + 1 :] -= np.outer(beta * v, v @ a[k:, k + 1 :])
        if k + 1 < n:
            v, beta, above[k] = _reflector(a[k, k + 1 :])
            if beta:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k + 1 :] @ v, beta * v)
            right.append((v, beta))
    return diagonal, above, right


def _dqds_sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One step to the qd array of the shifted matrix and its least pivot; None if the shift went beyond the least value."""
    new_q, new_e, d = [], [], q[0] - shift
    least = d
    for k in range(len(e)):
        if d < 0.0:
            return None
        pivot = d + e[k]
        if pivot <= 0.0:
            return None
        ratio = q[k + 1] / pivot
        new_q.append(pivot)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
        least = min(least, d)
    if d < 0.0:
        return None
    return [*new_q, d], new_e, least


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling."""
    found: list[float] = []
    # Stretches between negligible couplings: qd array and the shifts taken off so far.
    todo = [((diagonal**2).tolist(), (above**2).tolist(), 0.0, 0.0)]
    while todo:
        q, e, taken, least = todo.pop()
        if len(q) == 1:
            found.append(taken + q[0])
            continue
        cut = [k for k in range(len(e)) if e[k] <= _EPS**2 * (taken + min(q[k], q[k + 1])) or e[k] < _TINY]
        if cut:
            edges = [0, *(k + 1 for k in cut), len(q)]
            todo += [(q[a:b], e[a : b - 1], taken, 0.0) for a, b in zip(edges, edges[1:], strict=False)]
            continue
        if 1.5 * q[0] < q[-1]:
            q, e, least = q[::-1], e[::-1], 0.0
        # The least pivot of the last step is an upper bound; nearer shifts are tried first, and none is always safe.
        bound = min(least, q[-1])
        for shift in (bound * (1.0 - 4.0 * _EPS) - e[-1], 0.75 * bound, 0.25 * bound, 0.0):
            step = _dqds_sweep(q, e, max(shift, 0.0))
            if step is not None:
                todo.append((step[0], step[1], taken + max(shift, 0.0), step[2]))
                break
        else:  # a pivot of zero without a shift: the next one is below what doubles can tell from zero
            todo.append(([max(x, _TINY) for x in q], e, taken, 0.0))
    return np.sort(np.array(found))[::-1]


class _Twisted:
    """The factorisation N D N' of T - value, T being the product of the bidiagonal matrix with itself."""

    def __init__(self, pivots: np.ndarray, lower: np.ndarray, value: float):
        n = len(pivots)
        scale = float(np.max(np.abs(pivots))) or 1.0
        # A pivot of exactly zero gets the size of rounding.
        safe = lambda x: x if abs(x) > _TINY else _EPS * _EPS * scale
        self.down, self.up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
        self.top, self.bottom = np.zeros(n), np.zeros(n)
        s, p = np.zeros(n), np.zeros(n)
        s[0] = -value
        for k in range(n - 1):
            self.top[k] = safe(s[k] + pivots[k])
            self.down[k] = pivots[k] * lower[k] / self.top[k]
            s[k + 1] = self.down[k] * lower[k] * s[k] - value
        self.top[n - 1] = s[n - 1] + pivots[n - 1]
        p[n - 1] = pivots[n - 1] - value
        for k in range(n - 2, -1, -1):
            self.bottom[k + 1] = safe(pivots[k] * lower[k] ** 2 + p[k + 1])
            ratio = pivots[k] / self.bottom[k + 1]
            self.up[k] = lower[k] * ratio
            p[k] = p[k + 1] * ratio - value
        middle = s + p + value
        self.at = int(np.argmin(np.abs(middle)))
        self.middle = safe(float(middle[self.at]))

    def vector(self) -> np.ndarray:
        """Solves (T - value) z = a multiple of the unit vector at the twist."""
        z = np.zeros(len(self.top))
        z[self.at] = 1.0
        for k in range(self.at - 1, -1, -1):
            z[k] = -self.down[k] * z[k + 1]
        for k in range(self.at, len(z) - 1):
            z[k + 1] = -self.up[k] * z[k]
        return z / np.linalg.norm(z)

    def solve(self, x: np.ndarray) -> np.ndarray:
        u, n, at = x.copy(), len(x), self.at
        for k in range(at):
            u[k + 1] -= self.down[k] * u[k]
        for k in range(n - 2, at - 1, -1):
            u[k] -= self.up[k] * u[k + 1]
        z = np.zeros(n)
        z[at] = u[at] / self.middle
        for k in range(at - 1, -1, -1):
            z[k] = u[k] / self.top[k] - self.down[k] * z[k + 1]
        for k in range(at, n - 1):
            z[k + 1] = u[k + 1] / self.bottom[k + 1] - self.up[k] * z[k]
        return z / np.linalg.norm(z)


def _square_to(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            x = x - (o @ x) * o
    norm = float(np.linalg.norm(x))
    return x / norm if norm else x


def right_vectors(matrix: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Squares of all singular values, falling, and in the columns the right singular vectors of the first wanted."""
    n = matrix.shape[1]
    scale = float(np.max(np.abs(matrix), initial=0.0))
    if n == 0 or scale == 0.0:
        return np.zeros(n), np.eye(n)[:, :wanted]
    diagonal, above, right = bidiagonalise(matrix / scale)
    values = squared_values(diagonal, above)
    floor = _EPS * float(np.max(np.abs(diagonal)))
    held = np.where(np.abs(diagonal) > floor * _EPS, diagonal, floor * _EPS)
    pivots, lower = held**2, above / held[:-1]
    out: list[np.ndarray] = []
    for k, value in enumerate(values[:wanted].tolist()):
        near = [j for j in range(k) if values[j] - value <= CLUSTER * max(values[j], _EPS * values[0])]
        alone = not near and (k + 1 == n or value - values[k + 1] > CLUSTER * value)
        # In a cluster the value is moved by a few roundings: exact ties would make the factorisation break down early.
        twisted = _Twisted(pivots, lower, value if alone else value * (1.0 + 64.0 * _EPS))
        if alone:
            z = twisted.vector()
        else:
            others = [out[j] for j in near]
            z = _square_to(np.random.default_rng(k).standard_normal(n), others)
            for _ in range(6):
                z = _square_to(twisted.solve(z), others)
        out.append(z)
    vectors = np.array(out).T.reshape(n, len(out))
    for k in range(len(right) - 1, -1, -1):
        v, beta = right[k]
        if beta:
            vectors[k + 1 :] -= np.outer(beta * v, v @ vectors[k + 1 :])
    return values * scale**2, vectors
