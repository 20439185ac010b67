import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, shared passages, a hot group, nulls, empty, short and long texts."""
    rng = random.Random(5)
    words = [a + b for a in ("ka", "lo", "Mi", "nu", "é", "ß", "t") for b in ("ra", "si", "to", "x", "", "Ü")]
    texts = [sentence(rng, words, rng.randint(1, 160)) for _ in range(40)]
    passage = sentence(rng, words, 60)
    texts += [f"{sentence(rng, words, 9)} {passage}\n{sentence(rng, words, 12)}" for _ in range(6)]
    texts += [texts[3]] * 12 + [texts[4].upper()]
    for k in range(8):
        changed = texts[41].split()
        changed[k] = "other"
        texts.append("\t".join(changed))
    texts += [None, "", " \n\t ", "...", "a", "one two", "aaaa" * 200, "x y " * 300, sentence(rng, words, 4000)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    rows = df.collect()
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: r for r in rows}
