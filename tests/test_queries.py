"""Every query runs; those with SQL give the same rows as DuckDB. The problems tagged llm are left to tests/llm."""

import pytest

import __spark_entry__ as entry
import oracle
from marlstone.operators import collection_queries, coverage_queries, knowledge_queries, more_queries, oracle_queries, retrieval_queries, source_queries, timestamp_queries

OWN = {**retrieval_queries.QUERIES, **collection_queries.QUERIES, **more_queries.QUERIES, **knowledge_queries.QUERIES, **coverage_queries.QUERIES, **oracle_queries.QUERIES, **source_queries.QUERIES, **timestamp_queries.QUERIES}
SQL = {**retrieval_queries.SQL, **collection_queries.SQL, **more_queries.SQL, **knowledge_queries.SQL, **coverage_queries.SQL, **oracle_queries.SQL, **source_queries.SQL}


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, sf_dir, name):
    if name in SQL:
        ours, theirs, only_ours, only_theirs = oracle.compare(spark, OWN[name], SQL[name], sf_dir)
        assert ours == theirs and not only_ours and not only_theirs
    else:
        df = OWN[name](spark, sf_dir)
        assert df.columns and df.collect() is not None


def test_entry(spark, sf_dir):
    q = entry.queries()
    assert set(OWN) <= set(q) and set(entry.oracle_sql()) <= set(q)
    assert entry.entry(spark).columns
