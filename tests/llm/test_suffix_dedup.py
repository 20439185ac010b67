import random

import numpy as np
import pytest

from tallyledger.llm import suffix_dedup
from tallyledger.llm.suffix_array import common_prefixes, found_in, suffix_array, window_classes
from tallyledger.llm.suffix_dedup import remove_repeats

LENGTH = 100


def brute(rows, length=LENGTH):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (i, p):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in df.collect())


def test_equals_brute_force(documents, corpus):
    assert got(remove_repeats(documents)) == brute(corpus)


def test_runs_of_nul_bytes(spark):
    rng = random.Random(7)
    text = "".join(rng.choices("abcdefgh", k=60)) + "\0" * 100 + "".join(rng.choices("abcdefgh", k=60))
    rows = [(1, text), (2, f"other {text}"), (3, "x" * 40 + "\0" * 40 + "y" * 40), (4, "\0" * 150), (5, "x" * 40 + "\0" * 40 + "y" * 40)]
    assert got(remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_filter_bits_of_anchors_are_spread(spark):
    """Anchors are minima of many hashes; their bits must fill the filter evenly all the same."""
    text = "".join(random.Random(8).choices("abcdefgh", k=60000))
    rows = suffix_dedup._rows(spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string"))
    bits = np.frombuffer(suffix_dedup._repeated_filter(rows, LENGTH, 2 * len(text)), np.uint8)
    quarters = np.bitwise_count(bits).reshape(4, -1).sum(1)
    assert quarters.sum() > 1000 and quarters.min() > 0.7 * quarters.mean()


def test_a_common_line_gathers_no_text_around_it(spark):
    """A line of 60 bytes in every document is not the anchor of the windows that also hold other text."""
    rng = random.Random(9)
    line = "".join(rng.choices("abcdefgh", k=60))
    texts = ["".join(rng.choices("ijklmnop", k=150)) + line + "".join(rng.choices("ijklmnop", k=150)) for _ in range(300)]
    rows = list(enumerate([*texts, f"z{texts[7]}"]))
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    frequent = suffix_dedup._frequent_filter(suffix_dedup._rows(documents), LENGTH)
    part = suffix_dedup._Slice([(i, 0, 0, t.encode()) for i, t in rows], LENGTH, frequent)
    anchors = part.stretches(lambda a: np.ones(len(a), bool))[2]
    assert np.unique(anchors, return_counts=True)[1].max() < 20
    assert got(remove_repeats(documents)) == brute(rows)


def test_a_shorter_length(documents, corpus):
    assert got(remove_repeats(documents, 41)) == brute(corpus, 41)
    with pytest.raises(ValueError):
        remove_repeats(documents, 10)


def test_pieces_and_many_arrays(corpus):
    """Small bounds cut long texts in pieces and shards in many arrays; what goes stays the same."""
    pieces = []
    for i, t in corpus:
        raw = (t or "").encode()
        for at in range(0, len(raw) - LENGTH + 1, 300):
            pieces.append((i, 0, at, raw[at : at + 300 + LENGTH - 1]))
    part = suffix_dedup._Slice(pieces, LENGTH)
    first, run, _, _ = part.stretches(lambda a: np.ones(len(a), bool))
    of = np.searchsorted(part.begin, first, "right") - 1
    rows = np.zeros(len(first), suffix_dedup._STRETCH)
    rows["doc"] = np.array([p[0] for p in pieces])[of]
    rows["at"] = np.array([p[2] for p in pieces])[of] + first - part.begin[of]
    rows["run"] = run
    order = np.lexsort((rows["at"], rows["doc"]))
    raw = part.data.tobytes()
    texts = [raw[first[k] : first[k] + run[k] + LENGTH - 1] for k in order]
    before = suffix_dedup.ARRAY_BYTES
    try:
        suffix_dedup.ARRAY_BYTES = 2000
        found = suffix_dedup._shard_repeats(rows[order], texts, LENGTH)
    finally:
        suffix_dedup.ARRAY_BYTES = before
    starts = {(int(r["doc"]), int(r["at"]) + k) for r in found for k in range(r["run"])}
    seen, want = {}, set()
    for i, t in corpus:
        b = (t or "").encode()
        for p in range(len(b) - LENGTH + 1):
            if seen.setdefault(b[p : p + LENGTH], (i, p)) != (i, p):
                want.add((i, p))
    assert starts == want


def test_repeated_rows_nulls_clashes_and_empty(spark, no_documents):
    text = "".join(random.Random(1).choices("abcdefgh", k=180))
    rows = [(2, text, 1), (2, text, 1), (1, text[30:150], 1), (None, "z" + text, 1), (3, None, 1), (None, None, 1)]
    clash = spark.createDataFrame(rows, "doc_id bigint, text string, kept_ int")
    out = sorted((r.doc_id or 99, r.n_bytes, r.n_removed) for r in remove_repeats(clash).collect())
    assert out == [(1, 120, 0), (2, 180, 120), (2, 180, 120), (3, 0, 0), (99, 0, 0), (99, 181, 180)]
    assert remove_repeats(no_documents).count() == 0


def test_in_place_keeps_whole_characters(spark):
    text = "é" * 30 + "".join(random.Random(2).choices("abcdefgh", k=150))
    rows = [(1, "Ã" + text[30:]), (2, text), (3, None)]
    cut = remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), in_place=True)
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "Ã" + text[30:], 2: "é" * 30, 3: None}


@pytest.mark.parametrize("length", [8, 12, 20])
def test_suffix_array_prefixes_and_search(length):
    rng = np.random.default_rng(length)
    for _ in range(60):
        base = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 200)).astype(np.uint8)
        text = np.concatenate([base, base[: rng.integers(0, len(base) + 1)], rng.integers(97, 99, 30).astype(np.uint8), base[rng.integers(0, len(base)) :]])
        raw, order = text.tobytes(), suffix_array(text, length)
        assert [raw[i : i + length] for i in order] == sorted(raw[i : i + length] for i in range(len(raw)))
        for j, shared in enumerate(common_prefixes(text, order)[1:], 1):
            a, b = raw[order[j - 1] :], raw[order[j] :]
            assert shared == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        starts = np.flatnonzero(rng.random(max(len(raw) - length + 1, 0)) < 0.7)
        leftmost, firsts = window_classes(text, starts, length)
        known = {}
        for s, f in zip(starts.tolist(), leftmost.tolist(), strict=True):
            assert known.setdefault(raw[s : s + length], s) == f
        other = np.concatenate([base[2:], text[:40]])
        places = np.arange(max(len(other) - length + 1, 0))
        hits = found_in(other, places, text, firsts, length)
        for s, h in zip(places.tolist(), hits.tolist(), strict=True):
            w = other.tobytes()[s : s + length]
            assert (known.get(w, -1)) == (-1 if h < 0 else firsts[h])
