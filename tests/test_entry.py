import os
import re
import sys

import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "x_digest", "y_digest"]
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_oracle_keys_are_registered():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    core = {k for k in q if not re.match(r"op\d+_|pipeline$", k)}
    assert core - set(o) == {"train_vocab"}


def _norm(v):
    if isinstance(v, float):
        return repr(v)
    return str(v)


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_matches_duckdb_oracle(spark, key):
    con = duckdb.connect()
    for t in ["documents", "conversations", "benchmark", "embeddings", "events", "labels", "pages"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[key](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    so = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    oo = sorted(range(len(ocols)), key=lambda i: ocols[i])
    a = sorted(tuple(_norm(r[i]) for i in so) for r in df.collect())
    b = sorted(tuple(_norm(r[i]) for i in oo) for r in res.fetchall())
    assert a == b
