"""The registered queries against their SQL, and the pipeline against plain Python."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from docspark.llm import mixing, sharding
from docspark.llm.plans import QUERIES
from tests.compare import difference, duck
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
#: Larger tables where the smallest ones lack what the query looks for (lines that many documents share).
LARGER = {"op7_quality_rules": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.oracle])
def test_query_against_sql(spark, name):
    query, folder = QUERIES[name], LARGER.get(name, FOLDER)
    assert difference(query(spark, folder).toArrow(), duck(folder).execute(query.oracle).to_arrow_table()) is None


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.oracle])
def test_query_covers_its_table(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert Counter(r["doc_id"] for r in QUERIES[name](spark, FOLDER).collect()) == Counter(r["doc_id"] for r in docs.collect())


def test_simhash_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash_groups"](spark, FOLDER).collect()}
    assert got == {d: g for (d, _), g in zip(docs, brute.simhash_groups(docs))}


def test_pipeline(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = [tuple(r[n] for n in ("doc_id", "source", "size", "text_crc32", "place", "shard", "slot")) for r in corpus_pipeline.run(spark, FOLDER).collect()]
    assert sorted(got, key=lambda r: r[4]) == brute.pipeline(docs, items, mixing.SEED, sharding.SEED)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns, name
