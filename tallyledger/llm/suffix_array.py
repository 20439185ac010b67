"""Suffix arrays of a byte string in numpy: refinement by doubling, common prefixes, search of one in another."""

from __future__ import annotations

import numpy as np


def words_of(text: np.ndarray, order: str = ">") -> np.ndarray:
    """The eight bytes from every place as one number, zeros beyond the end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    return np.ndarray(len(text), f"{order}u8", padded.tobytes(), 0, (1,)).astype(np.uint64)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes at least; those that still tie, by place.

    Larsson and Sadakane's refinement: after a sort by the first eight bytes, every round doubles the sorted
    length, by the rank of the suffix so much further on, and touches only groups that are not yet single.
    """
    n = len(text)
    words = words_of(text)
    order = np.argsort(words)
    ordered = words[order]
    start = np.empty(n, bool)
    start[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=start[1:])
    del words, ordered
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    length = 8
    while True:
        tied = ~start
        tied[:-1] |= tied[1:]
        open_ = np.flatnonzero(tied)
        if not len(open_):
            return order
        group = rank[order[open_]]
        done = length >= depth
        if done:
            second = order[open_]
        else:
            ahead = order[open_] + length
            second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        keys = group * (n + 1) + second
        sorted_ = np.argsort(keys)
        order[open_] = order[open_][sorted_]
        if done:
            return order
        keys = keys[sorted_]
        fresh = np.empty(len(keys), bool)
        fresh[:1] = True
        np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
        start[open_] = fresh
        rank[order[open_]] = np.maximum.accumulate(np.where(fresh, open_, 0))
        length *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of the order shares with the one before it (0 for the first).

    Kasai's observation in columns: where a suffix and its predecessor both move one byte on, what they share is one
    less. Only where that chain breaks are bytes compared, eight at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    chained = np.zeros(n, bool)
    chained[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    # Two suffixes that share nothing say nothing about the next two.
    chained[1:] &= text[:-1] == text[np.maximum(before[:-1], 0)]
    heads = np.flatnonzero(~chained & (before >= 0))
    shared = np.zeros(n, np.int64)
    words = words_of(text, "<")
    a, b, live = heads, before[heads], np.arange(len(heads))
    found = np.zeros(len(heads), np.int64)
    while len(live):
        room = n - np.maximum(a, b)  # bytes left in the later of the two
        differ = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        low = differ & (~differ + np.uint64(1))
        # Places of the lowest differing byte; 8 where the words are equal.
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        same = np.minimum(same, np.maximum(room, 0))
        found[live] += same
        go = (same == 8) & (room > 8)
        a, b, live = a[go] + 8, b[go] + 8, live[go]
    shared[heads] = heads + found
    # A chain carries place + shared bytes on unchanged.
    reach = np.maximum.accumulate(np.where(chained, 0, np.arange(n) + 1))
    head_of = reach - 1
    shared = np.where(before >= 0, shared[head_of] - np.arange(n), 0)
    return np.maximum(shared, 0)[order]


def window_classes(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of `length` bytes from these places, the leftmost place with an equal window; and those leftmost places
    in the order of their bytes."""
    order = suffix_array(text, length)
    joined = common_prefixes(text, order) >= length
    is_window = np.zeros(len(text), bool)
    is_window[starts] = True
    kept = is_window[order]
    # Classes are runs of the order; suffixes that are no windows drop out, the runs stay whole.
    label = np.cumsum(~joined)[kept]
    places = order[kept]
    by_place = np.argsort(label * len(text) + places)
    label, places = label[by_place], places[by_place]
    first = np.empty(len(label), bool)
    first[:1] = True
    np.not_equal(label[1:], label[:-1], out=first[1:])
    leftmost = np.zeros(len(text), np.int64)
    leftmost[places] = places[np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))]
    return leftmost[starts], places[first]


def _compare(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 for the windows at a of the left words against those at b of the right words."""
    sign = np.zeros(len(a), np.int8)
    offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    live = np.arange(len(a))
    for k in offsets:
        x, y = left[a[live] + k], right[b[live] + k]
        sign[live] = (x > y).astype(np.int8) - (x < y).astype(np.int8)
        live = live[x == y]
        if not len(live):
            break
    return sign


def found_in(text: np.ndarray, windows: np.ndarray, other: np.ndarray, sorted_windows: np.ndarray, length: int) -> np.ndarray:
    """For windows of the text, which of the other text's windows, given in the order of their bytes, is equal: binary
    search; -1 for none."""
    mine, theirs = words_of(text), words_of(other)
    first = theirs[sorted_windows]
    # The first eight bytes narrow the range; whole windows decide inside it.
    low = np.searchsorted(first, mine[windows], "left")
    high = np.searchsorted(first, mine[windows], "right")
    hit = np.full(len(windows), -1, np.int64)
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) // 2
        sign = _compare(mine, windows[live], theirs, sorted_windows[middle], length)
        hit[live[sign == 0]] = middle[sign == 0]
        low[live] = np.where(sign > 0, middle + 1, low[live])
        high[live] = np.where(sign < 0, middle, high[live])
        live = live[(sign != 0) & (low[live] < high[live])]
    return hit
