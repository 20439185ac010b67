import random

import numpy as np
import pytest

from tallyledger.llm.langid import fit, identify, ngram_counts

PARTS = {"en": "the th er on ing ed at", "de": "sch ein ung ch über ß", "fr": "eau eux où é tion qu"}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)

    def text(lang):
        parts = PARTS[lang].split()
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))

    rows = [(k, text(lang := rng.choice([*PARTS])), lang) for k in range(300)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_held_out_accuracy(labelled):
    model = fit(labelled.where("doc_id % 3 <> 0"), per_language=50)
    told = identify(labelled.where("doc_id % 3 = 0"), model, ("doc_id", "lang")).collect()
    assert np.mean([r.lang == r.lang_pred for r in told]) > 0.98
    assert not any(r.rejected for r in told) and all(0 < r.score <= 1 for r in told)


def test_prediction_is_the_nearest_centroid(labelled):
    model = fit(labelled)
    assert model.languages == sorted(model.languages) and len(model.languages) == 12
    for row in identify(labelled, model, ("doc_id", "text")).limit(20).collect():
        vector = np.log1p(ngram_counts(row.text)) * model.idf
        cosines = model.centroids @ (vector / np.linalg.norm(vector))
        assert row.lang_pred == model.languages[int(cosines.argmax())]
        assert row.score == pytest.approx(float(cosines.max()), abs=1e-5)


def test_no_letters_far_texts_and_clashes(spark, labelled):
    model = fit(labelled)
    rows = [(1, None, 0), (2, "", 0), (3, "12 !? ...", 0), (4, "Жщю Цфы", 0), (None, "the thing", 0), (5, "the " * 400_000, 0)]
    clash = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = {r.doc_id: r for r in identify(clash, model).collect()}
    for k in (1, 2, 3):
        assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
    assert got[4].rejected and got[4].lang_pred in PARTS
    assert got[None].lang_pred == "en" and got[5].lang_pred == "en"


def test_nothing_to_learn(spark, labelled, no_documents):
    empty = fit(no_documents)
    assert {r.lang_pred for r in identify(labelled.limit(3), empty).collect()} == {"und"}
    assert identify(no_documents, fit(labelled)).count() == 0
    unlabelled = spark.createDataFrame([(1, "the", None), (2, None, "en")], labelled.schema)
    assert fit(unlabelled).languages == []


def test_no_cluster_is_a_stray_text(spark, labelled):
    """Words that no other row has, under a learned label, do not get a centroid of their own."""
    stray = spark.createDataFrame([(1000 + k, w, "en") for k, w in enumerate(("жщю", "цфы"))], labelled.schema)
    learned = labelled.union(stray)
    model, rows = fit(learned), learned.collect()
    for language in PARTS:
        own = [r.text for r in rows if r.lang == language]
        cells = [k for k, name in enumerate(model.languages) if name == language]
        vectors = np.stack([np.log1p(ngram_counts(t)) * model.idf for t in own])
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        sizes = np.bincount((vectors @ model.centroids[cells].T).argmax(1), minlength=len(cells))
        assert len(cells) > 1 and (sizes >= 0.02 * len(own)).all()


def test_rows_that_share_an_id_are_learned_within_the_bound(spark, labelled):
    model = fit(labelled)
    many = spark.range(3000).selectExpr("1L AS doc_id", "'the thing is on' AS text", "'en' AS lang")
    again = fit(many.union(labelled.selectExpr("doc_id + 5 AS doc_id", "text", "lang")))
    assert set(again.languages) == set(model.languages)
    texts = spark.range(3000).selectExpr("1L AS doc_id", "concat('the ', repeat('er ', id)) AS text", "'en' AS lang")
    assert set(fit(texts, per_language=20).languages) == {"en"}


def test_kept_columns_with_names_of_results_give_way(spark, labelled):
    clash = labelled.limit(3).selectExpr("doc_id", "text", "7 AS score", "'x' AS lang_pred", "1 AS Rejected")
    got = identify(clash, fit(labelled), tuple(clash.columns))
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "rejected"] and got.first().score <= 1
