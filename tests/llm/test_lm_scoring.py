import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyledger.llm.lm_scoring import _levels, expected_count, score_documents
from tallyledger.llm.text import fold_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def score(df, **options):
    return score_documents(df, fold_of(F.col("doc_id"), 5) != 1, **options)


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def brute(rows):
    """Base figures, and the score with true counts put through the quantisation."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for _, t in rows]
    trained = [not held_out(i) for i, _ in rows]
    words = Counter(w for k, x in enumerate(tokens) if trained[k] for w in x)
    pairs = Counter(p for k, x in enumerate(tokens) if trained[k] for p in zip(["^", *x], x, strict=False))
    n, v, ends = sum(words.values()), len(words), words[None]

    def one(x):
        base = score = 0.0
        for before, after in zip(["^", *x], x, strict=False):
            plain = (words[after] + 0.5) / (n + 0.5 * (v + 1))
            c = ends if before == "^" else words[before]
            level = pairs[before, after].bit_length()
            seen = min(2 ** (level - 1) if level else 0, c, words[after])
            weight = 0.5 * c / (c + 4.0)
            base += math.log10(plain)
            score += math.log10(weight * seen / max(c, 1) + (1 - weight) * plain)
        return (len(x), sum(words[w] > 0 for w in x), n, base, score)

    return [one(x) for x in tokens]


def same(df, rows):
    want = sorted((i is None, i or 0, *b) for (i, _), b in zip(rows, brute(rows), strict=True))
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = sorted((r.doc_id is None, r.doc_id or 0, *(r[c] for c in names)) for r in df.collect())
    assert [w[:5] for w in want] == [g[:5] for g in got]
    for w, g in zip(want, got, strict=True):
        assert math.isclose(w[5], g[5], rel_tol=1e-9)
        # A false positive of the filter can only raise a few of the probabilities.
        assert g[6] > w[6] - 1e-6 and math.isclose(w[6], g[6], rel_tol=0.02)


def test_scores_equal_true_counts(documents, corpus):
    same(score(documents), corpus)


def test_probes_sent_to_the_segments_give_the_same(documents):
    near = score(documents).collect()
    far = score(documents, max_broadcast=0).collect()
    assert sorted(near) == sorted(far)


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "A b c"), (2, "a B"), (2, "a B"), (4, None), (5, "")]
    same(score(spark.createDataFrame(rows, "doc_id bigint, text string")), rows)


def test_extra_columns_and_empty_table(spark, no_documents):
    assert score(no_documents).count() == 0
    clash = spark.createDataFrame([(1, "a b", 9, "x")], "doc_id bigint, text string, score int, block string")
    assert score(clash).first().n_tokens == 3


def test_no_training_rows(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    r = score_documents(rows, F.lit(False)).first()
    assert (r.n_known, r.train_tokens) == (0, 0) and r.score == r.base_score == 0.0


def test_levels():
    assert _levels(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]
    assert expected_count(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2, 4]


def test_probabilities_of_a_context_add_up_to_one_at_most(corpus):
    """The quantised count never exceeds the count, so no context hands out more than it has."""
    counts = np.arange(1, 5000)
    assert (expected_count(_levels(counts)) <= counts).all()
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for _, t in corpus]
    tokens.append([x for k in range(1000) for x in ("ctx", f"w{k // 3}")])
    words = Counter(w for x in tokens for w in x)
    n, v = sum(words.values()), len(words)
    follow = {}
    for x in tokens:
        for before, after in zip(x, x[1:], strict=False):
            follow.setdefault(before, Counter())[after] += 1
    assert len(follow) > 300 and len(follow["ctx"]) == 334
    for before, nexts in follow.items():
        c = words[before]
        weight = 0.5 * c / (c + 4.0)
        levels = expected_count(_levels(np.array(list(nexts.values()))))
        seen = sum(min(x, c, words[w]) for x, w in zip(levels, nexts, strict=True))
        # All known words and one unknown have a smoothed share of 1 in all.
        smoothed = (sum(words.values()) + 0.5 * v + 0.5) / (n + 0.5 * (v + 1))
        assert weight * seen / c + (1 - weight) * smoothed <= 1 + 1e-12
