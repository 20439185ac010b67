"""Registered queries against their SQL, and the pipeline against the plain rules of its stages."""

import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tallyledger.llm import queries
from tests.test_oracle import _rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, sql, name):
    df = queries.queries()[name](spark, SF)
    found = sql.execute(queries.oracle_sql()[name])
    assert _rows(df.columns, df.collect()) == _rows([c[0] for c in found.description], found.fetchall())


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names


def test_pipeline(spark, tmp_path):
    from tests.llm import test_decontamination as deco, test_near_duplicates as near, test_suffix_dedup as suffix

    source = spark.read.parquet(f"{SF}/documents.parquet")
    columns = source.columns
    docs, seen = source, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "bpe" or docs.columns == columns
    texts = {k: {i: r.text for i, r in rows.items()} for k, rows in seen.items() if k != "bpe"}
    assert len(texts["language_id"]) >= 0.99 * source.count()
    classes = near.brute([*texts["language_id"].items()])
    assert seen["jaccard_join"].keys() == {i for i, (c, _) in classes.items() if c == i}
    cut = {i: kept.decode("utf-8", "ignore") for i, _, _, _, kept in suffix.brute([*texts["jaccard_join"].items()])}
    assert texts["suffix_dedup"] == {i: t for i, t in cut.items() if t or not texts["jaccard_join"][i]}
    assert all(r.n_chars == len(r.text) for r in seen["suffix_dedup"].values())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {tuple(w[k : k + 13]) for _, t in items for w in [deco.words(t)] for k in range(len(w) - 12)}
    assert all(len(deco.words(t)) >= 13 for _, t in items)

    def clean(text):
        w = deco.words(text)
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for p in range(k, k + 13)}
        return not hit or 20 * len(hit) < len(w)

    assert seen["decontamination"].keys() == {i for i, t in texts["suffix_dedup"].items() if clean(t)}
    assert seen["bpe"].keys() == seen["decontamination"].keys()
    assert corpus_pipeline.run(spark, SF).count() == len(seen["bpe"])
