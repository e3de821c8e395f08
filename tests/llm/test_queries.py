"""The registered queries on a small table set."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from cartwise.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(contract.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = connection.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    theirs = Counter(tuple(r) for r in result.fetchall())
    ours = contract.queries()[name](spark, SF_DIR)
    assert sorted(ours.columns) == sorted(names)
    assert Counter(tuple(r) for r in ours.select(*names).collect()) == theirs


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR)
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        rows = {r.doc_id: r.text for r in after.collect()}
        assert set(rows) <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame([r for r in after.collect()], docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.collect()} == set(rows)
