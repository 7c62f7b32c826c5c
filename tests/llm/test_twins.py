"""Registered queries that have a SQL twin, against it."""

import collections

import duckdb
import pytest

import __spark_entry__ as entry
from aeromart.llm.oracle import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ours = entry.queries()[name](spark, SF)
    theirs = con.execute(entry.oracle_sql()[name])
    names = sorted(ours.columns)
    at = {d[0]: i for i, d in enumerate(theirs.description)}
    assert sorted(at) == names
    a = collections.Counter(tuple(r[c] for c in names) for r in ours.collect())
    b = collections.Counter(tuple(r[at[c]] for c in names) for r in theirs.fetchall())
    assert a == b and a
