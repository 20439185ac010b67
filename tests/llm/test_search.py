import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyledger.llm import search as s
from tallyledger.llm.search import build_index, search
from tests.llm.conftest import SCHEMA, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, queries, k):
    """rank, key and score of the first k rows for every distinct (id, terms)."""
    docs = [(i, Counter(t)) for i, text in rows for t in [terms_of(text)] if t]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for i, terms in {(i, tuple(terms_of(t))) for i, t in queries}:
        scored = []
        for doc, counts in docs:
            m = 100 - 75 + (75 * counts.total() * n_docs) // n_terms
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * (1000000000 * counts[t] // (1000 * counts[t] + 8 * m)) for t in terms)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(i, r, None if none else doc, -score) for r, (score, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def queries(corpus):
    rng = random.Random(8)
    texts = [t for _, t in corpus if t and len(t) > 60]
    some = [(i, " ".join(rng.choices(terms_of(rng.choice(texts)), k=6)) + f" unheard{i}") for i in range(14)]
    return [*some, (14, texts[3]), (15, "x x x y, X"), (16, None), (17, "... !"), (18, "nowhere"), some[0], (0, "x"), (None, "one two")]


def asked(spark, queries):
    return spark.createDataFrame([(i, t, 9) for i, t in queries], "item_id bigint, text string, score int")


@pytest.mark.parametrize("sizes", [{}, {"GROUP": 8, "QUERIES": 4, "_TERMS_TOGETHER": 5, "HELD_TERMS": 50, "MORE": 0}, {"LARGEST": 8, "PROBES": 1, "FILTER_BITS": 1}])
def test_against_brute_force(spark, documents, corpus, queries, sizes, monkeypatch):
    for name, size in sizes.items():
        monkeypatch.setattr(s, name, size)
    index = build_index(documents)
    wanted = [t for _, t in corpus if terms_of(t)]
    assert (index.n_docs, index.n_terms) == (len(wanted), sum(len(terms_of(t)) for t in wanted))
    for k in (10,) if sizes else (10, 1000):
        got = search(index, documents, asked(spark, queries), k=k)
        assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
        assert found(got) == brute(corpus, queries, k)


def test_ties_repeated_rows_and_null_keys(spark):
    rows = [(i, "red fish blue fish") for i in range(40, 0, -1)] + [(7, "red fish blue fish")] * 3 + [(None, "red"), (None, "red"), (3, None), (4, "")]
    rows += [(100 + i, sentence(random.Random(i), ["green", "grey", "fish"], 4 + i)) for i in range(30)]
    queries = [(1, "red"), (2, "fish"), (3, "blue red"), (None, "green grey")]
    df = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], SCHEMA).repartition(6)
    clash = df.selectExpr("*", "1 AS doc", "2 AS check", "3 AS bit", "4 AS rank")
    for k in (3, 60):
        assert found(search(build_index(clash), clash, asked(spark, queries), k=k)) == brute(rows, queries, k)


def test_empty_tables(spark, documents, no_documents, queries):
    assert search(build_index(no_documents), no_documents, asked(spark, queries)).count() == 0
    assert search(build_index(documents), documents, asked(spark, [])).count() == 0
    assert search(build_index(documents), documents, asked(spark, [(1, None), (2, "?")])).count() == 0


def test_bounds_are_never_below_the_score():
    rng = random.Random(2)
    words = ["a", "b", "c", "dd", "é", "5"]
    texts = [sentence(rng, words, rng.choice([1, 3, 40, 700])).encode() for _ in range(30)]
    groups = s._Groups()
    batches = []
    for k, text in enumerate(texts):
        hashes, sizes = s.word_hashes([text], s.SEPARATORS)
        terms, counts = np.unique(hashes, return_counts=True)
        level = [(t, v) for t, c in zip(terms, counts, strict=True) for v in range(np.searchsorted(s.LEVELS, c, "right"))]
        keys = s._keys(np.array([t for t, _ in level]), np.array([v for _, v in level]))
        batches += groups.add(k, 0, int(sizes[0]), keys)
    batches += [groups.closed(bits) for bits in sorted(groups.waiting)]
    hashes = s.word_hashes([" ".join(words).encode()], s.SEPARATORS)[0]
    wanted = [[(0, 1)], [(1, 2), (4, 1)], [(k, 1) for k in range(6)]]
    block = s._Block([w.encode() for w in words], hashes, np.arange(1000, 1006), wanted, 30, sum(len(t.split()) for t in texts))
    met = 0
    for batch in batches:
        for docs, _, sizes, slices in s._groups_of(batch.select(["docs", "checks", "sizes", "slices"])):
            bounds = block.bounds(sizes, slices)
            for p, k in enumerate(docs):
                exact = block.scores(texts[k], [0, 1, 2])
                assert all(b >= e for b, e in zip(bounds[:, p], exact, strict=True))
                assert all(b <= 2 * e for b, e in zip(bounds[:, p], exact, strict=True) if e)
                met += 1
    assert met == 30
