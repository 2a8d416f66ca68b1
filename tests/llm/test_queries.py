"""Registered queries against their SQL twins, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from secretsift.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    frame = QUERIES[name](spark, DATA)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in frame.collect()))) == sorted(map(repr, cursor.fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert kept.columns == docs.columns and 0.5 * docs.count() < kept.count() < docs.count()
    out = corpus_pipeline.run(spark, DATA)
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in kept.collect()}
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)


def test_pipeline_of_nothing(spark, docs):
    none = docs([]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, DATA)
    assert none.count() == 0
