"""64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


WHITE = bytes([32, 9, 10, 11, 12, 13])


@functools.lru_cache(maxsize=4)
def _tables(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased, and which bytes separate words."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[list(separators)] = True
    return lower, space


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], separators: bytes = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, A-Z lower-cased, words between the separating bytes; how many each text has.

    All texts are one array of bytes: a word's hash is a difference of running sums of a polynomial.
    """
    lower, space = _tables(separators)
    sizes = np.array([len(t) for t in texts], np.int64)
    data = lower[np.frombuffer(b"".join(texts), np.uint8)]
    ends_at = np.cumsum(sizes)
    in_word = ~space[data]
    begins = in_word.copy()
    begins[1:] &= ~in_word[:-1]
    edge = (ends_at - sizes)[sizes > 0]
    begins[edge] = in_word[edge]
    first = np.flatnonzero(begins)
    of = np.searchsorted(ends_at, first, "right")
    # A word ends at the next white space or at the end of its text.
    stop = np.flatnonzero(~in_word)
    after = np.append(stop, len(data))[np.searchsorted(stop, first)]
    end = np.minimum(after, ends_at[of])
    power = powers(len(data) + 1)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])))
    # Divided by the power of its place, a word's sum is the same wherever it stands.
    word = finish((running[end] - running[first]) * powers(len(data) + 1, _INVERSE)[first])
    word = finish(word + (end - first).astype(np.uint64))
    n_words = np.bincount(of, minlength=len(texts)).astype(np.int64)
    return word, n_words


def grouped(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Where a group begins in the batch and its texts as UTF-8 (null: empty), a bounded number of bytes at a time."""
    begin, held, size = 0, [], 0
    for k, value in enumerate(column):
        held.append((value.as_py() or "").encode())
        size += len(held[-1])
        if size >= most:
            yield begin, held
            begin, held, size = k + 1, [], 0
    if held:
        yield begin, held
