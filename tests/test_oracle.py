"""Every registered query against its DuckDB twin on the smallest tables:
same columns, same row count, same multiset of rows."""

import collections
import datetime as dt
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from aeromart.plans.oracle import SQL
from aeromart.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None or v is pd.NaT or (not isinstance(v, (str, bytes)) and pd.isna(v) is True):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return None if isinstance(v, float) and math.isnan(v) else repr(float(v))
    if isinstance(v, (pd.Timestamp, dt.date)):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    return repr(v)


def multiset(df):
    cols = sorted(df.columns)
    return collections.Counter(tuple(norm(x) for x in rec) for rec in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_a_sql_twin():
    assert set(SQL) == set(QUERIES) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "revenue" in df.columns


SAME_TYPE = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER",
             "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql_twin(spark, con, name):
    df = entry.queries()[name](spark, SF)
    ours = df.toPandas()
    rel = con.execute(entry.oracle_sql()[name])
    duck_types = {d[0]: str(d[1]) for d in rel.description}
    theirs = rel.df()
    assert {f.name: SAME_TYPE.get(f.dataType.simpleString()) for f in df.schema.fields} == duck_types
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    assert multiset(ours) == multiset(theirs)
