"""The queries against SQL, and the pipeline's stages against each other and brute force."""

import collections
import re

import corpus_pipeline
import pytest
from compare import compare, duck
from test_pairs import brute_components
from test_texts import brute_leaks

from freqloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    diff = compare(spark, con, name, queries.QUERIES[name], queries.ORACLES.get(name), SF)
    assert diff is None, diff


def test_stages(spark, documents, tmp_path):
    docs, held = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == COLUMNS
        held.append({r.doc_id: r.text for r in docs.collect()})
    start = {r.doc_id: r.text for r in documents.collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good & held[0].keys()) >= 0.97 * len(good) and len(bad & held[0].keys()) <= 0.4 * len(bad)
    assert all(start[i] == t for i, t in held[0].items())
    first = {}
    for i in sorted(held[0]):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", held[0][i] or ""), i)
    assert set(held[1]) == set(first.values())
    kept = {i for (i, _, c, _) in brute_components(list(held[1].items())) if i == c}
    assert set(held[2]) == kept
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(held[3]) == set(held[2]) - {i for i, _ in brute_leaks(list(held[2].items()), items)}


def test_stages_keep_the_order_of_columns(spark, documents):
    """Columns stay where they are, also where the id is not the first."""
    docs = documents.limit(20).select("text", "n_chars", "doc_id", "source", "lang")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    by = collections.Counter()
    for r in rows:
        by[r.doc_id] += r.length
    assert rows and all(by[r.doc_id] == r.doc_tokens for r in rows)


def test_stages_take_empty_tables(spark, documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), SF).count() == 0
