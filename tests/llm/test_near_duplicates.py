import re
from collections import Counter

import pytest

from tallyledger.llm.components import connected_components
from tallyledger.llm.near_duplicates import bands_for, similarity_classes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(rows, similarity=0.8):
    sets = {i: shingles(t) for i, t in rows}
    links, root = Counter(), {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return {i: (root[i], links[i]) for i in sets}


@pytest.mark.parametrize("block", [256, 4])
def test_classes_and_links_equal_all_pairs(documents, corpus, block):
    got = {r.doc_id: (r.class_id, r.n_links) for r in similarity_classes(documents, block=block).collect()}
    assert got == brute(corpus)
    assert max(n for _, n in got.values()) >= 12


def test_pairs_exactly_at_the_similarity(spark):
    """Of 12/15, 24/30 and 28/35 n-grams: 0.8 is linked, and one n-gram less in common is not."""
    rows = []
    for k, (words, more) in enumerate([(16, 3), (28, 6), (32, 7)]):
        text = [f"w{k}x{j}" for j in range(words + more + 1)]
        rows += [(10 * k, " ".join(text[:words])), (10 * k + 1, " ".join(text[: words + more]))]
        rows += [(10 * k + 2, " ".join(f"v{w}" for w in text[:words])), (10 * k + 3, " ".join(f"v{w}" for w in text))]
    classes = similarity_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in classes.collect()}
    assert got == brute(rows)
    assert [got[10 * k + 1] for k in range(3)] == [(10 * k, 1) for k in range(3)]
    assert [got[10 * k + 3][1] for k in range(3)] == [0, 0, 0]


def test_nulls_repeats_clashes_and_empty(spark, no_documents):
    rows = [(1, "a b c", 1), (1, "a b c", 1), (2, "A  b\nc", 1), (3, None, 1), (4, "", 1), (None, "q r s t u v", 1), (6, "q", 1)]
    clash = spark.createDataFrame(rows, "doc_id bigint, text string, node int")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in similarity_classes(clash).collect())
    assert got == [(0, 0, 0), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0), (6, 6, 0)]
    assert similarity_classes(no_documents).count() == 0


def test_bands_reach_the_recall():
    bands, rows = bands_for(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99999
    with pytest.raises(ValueError):
        bands_for(0.1, most=4)


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
