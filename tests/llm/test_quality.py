import re
from collections import Counter

import pytest

from tallyledger.llm.quality import apply_quality_rules, base_failure, host_verdicts, text_statistics

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    met = Counter(grams)
    repeated = {p for k, g in enumerate(grams) if met[g] > 1 for p in range(k, k + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))


def test_statistics_equal_brute_force(spark, documents, corpus):
    extra = [(900, "a\na\n \n\na\r\n# | <>"), (901, "é " * 7), (902, "\x0b\x1c\x85 x")]
    rows = [*corpus, *extra]
    more = spark.createDataFrame(extra, "doc_id bigint, text string")
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in text_statistics(documents.select("doc_id", "text").union(more)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_hosts_are_shrunk_towards_all(spark):
    good = " ".join(f"w{k}" for k in range(20))
    rows = [(k, good if k % 10 else "bad", "big") for k in range(100)]
    rows += [(200, "bad", "tiny"), (300, good, None)] + [(400 + k, "bad", "junk") for k in range(60)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    judged = text_statistics(documents).withColumn("base_failed", base_failure())
    hosts = {r.host: r for r in host_verdicts(judged).collect()}
    assert hosts["big"].host_ok and not hosts["junk"].host_ok
    assert hosts["big"].rate_thin < hosts["tiny"].rate_thin < hosts["junk"].rate_thin
    kept = {r.doc_id: r.kept for r in apply_quality_rules(documents).collect()}
    assert kept == {i: t == good and s != "junk" for i, t, s in rows}


def test_repeats_clashes_and_empty(spark, no_documents):
    assert apply_quality_rules(no_documents).count() == 0
    clash = spark.createDataFrame([(1, "a", "s", 0), (1, "a", "s", 0)], "doc_id bigint, text string, source string, n_docs int")
    assert [r.kept for r in apply_quality_rules(clash).collect()] == [False, False]


@pytest.mark.parametrize("text", [None, "", " \n"])
def test_no_words(spark, text):
    r = apply_quality_rules(spark.createDataFrame([(1, text, None)], "doc_id bigint, text string, source string")).first()
    assert (r.n_words, r.word_chars, r.base_failed, r.kept) == (0, 0, True, False)
