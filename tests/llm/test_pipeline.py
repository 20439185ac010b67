"""Stages of the pipeline on rows with nulls, repeats, clashing columns, and none."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

CLASHES = (
    "score rejected lang_pred n_bytes n_removed spans kept class_id n_links n_copies n_hit n_words _key _first _same _own_0 key"
    " shard ids block salt"
).split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    items = [(1, " ".join(f"bench{k}" for k in range(20)))]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("stage", range(5))
def test_rows_of_all_kinds(spark, folder, documents, stage):
    name, function = corpus_pipeline.STAGES[stage]
    odd = [(None, "a text without an id", "en", None, 20), (None, None, None, None, None), (900, "", "en", "s", 0)]
    odd += [(901, "twice the same row here", "en", "s", 23)] * 2
    docs = documents.union(spark.createDataFrame(odd, documents.schema))
    clash = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    got = function(spark, clash, folder)
    rows = got.collect()
    assert any(r.doc_id is None for r in rows) and any(r.doc_id == 901 for r in rows)
    if name == "bpe":
        assert len(rows) == clash.count()
        return
    assert got.columns == clash.columns
    assert all(r[c] == k for r in rows for k, c in enumerate(CLASHES))
    plain = function(spark, docs, folder).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in plain))) == sorted(map(repr, ((r.doc_id, r.text) for r in rows)))
    assert sum(r.doc_id == 901 for r in rows) == (1 if name == "jaccard_join" else 2)


@pytest.mark.parametrize("stage", range(5))
def test_no_rows(spark, folder, no_documents, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, no_documents, folder).count() == 0
