import re

import pytest

from tallyledger.llm.decontamination import clean_documents, contaminated, scan_hits

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(13, len(b))
        for k in range(len(b) - n + 1 if b else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == b[k : k + n]:
                    hit.update(range(at, at + n))
                    ids.add(item)
    return len(w), sorted(hit), sorted(str(i) for i in ids if i is not None)


@pytest.fixture(scope="module")
def items(corpus):
    long = [t for _, t in corpus if t and 40 < len(t.split()) < 200]
    middle = [(n, " ".join(t.split()[5 : 5 + size])) for n, (t, size) in enumerate(zip(long, (30, 13, 12, 5, 20), strict=False))]
    return [*middle, (7, None), (8, "..."), (9, "ONE-two"), (9, "one two"), (None, "x y"), (3, "no such words anywhere at all")]


@pytest.fixture(scope="module")
def benchmark_table(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("most", [50_000, 0])
def test_hits_equal_brute_force(documents, corpus, benchmark_table, items, most):
    got = {r.doc_id: r for r in scan_hits(documents, benchmark_table, ["doc_id"], max_broadcast=most).collect()}
    assert any(r.hit_words for r in got.values())
    for i, text in corpus:
        n, hit, ids = brute(text, items)
        assert (got[i].n_words, got[i].hit_words, got[i]["items"]) == (n, hit, ids), text


def test_dropping_and_cutting(documents, corpus, benchmark_table, items):
    bad = {i for i, t in corpus if (b := brute(t, items))[1] and 20 * len(b[1]) >= b[0]}
    assert bad
    assert {r.doc_id for r in clean_documents(documents, benchmark_table).collect()} == {i for i, _ in corpus} - bad
    cut = {r.doc_id: r.text for r in clean_documents(documents, benchmark_table, "cut").collect()}
    for i, text in corpus:
        _, hit, _ = brute(text, items)
        assert words(cut[i]) == [w for k, w in enumerate(words(text)) if k not in set(hit)]
        assert hit or cut[i] == text


def test_empty_tables_repeats_and_clashes(spark, documents, no_documents, benchmark_table):
    nothing = benchmark_table.limit(0)
    assert scan_hits(documents, nothing, ["doc_id"]).where(contaminated()).count() == 0
    assert scan_hits(no_documents, benchmark_table, ["doc_id"]).count() == 0
    rows = [(1, "one two", 5), (1, "one two", 5), (None, "one two three", 6)]
    clash = spark.createDataFrame(rows, "doc_id bigint, text string, items int")
    got = sorted((r.doc_id or 0, r.n_words, r.hit_words) for r in scan_hits(clash, benchmark_table, ["doc_id"]).collect())
    assert got == [(0, 3, [0, 1]), (1, 2, [0, 1]), (1, 2, [0, 1])]
    assert clean_documents(clash, benchmark_table).count() == 0
    assert clean_documents(clash, nothing).columns == clash.columns
