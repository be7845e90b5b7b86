"""Driver contract: entry(), queries(), oracle_sql(); every query against its
oracle at sf0.001 (DuckDB over the same parquet)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from answer_eval.plans import catalog
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
            "boolean": "BOOLEAN"}


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_entry_runs_and_matches_fixture_shape(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns[:3] == ["id", "score", "accuracy"] and len(df.columns) == 22
    for r in rows:
        assert r.correct + r.incorrect + r.parse_errors == r.total == 200


def test_registry_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(catalog.QUERIES) <= set(q)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    otypes = {d[0]: str(d[1]).upper() for d in res.description}
    for f in df.schema.fields:
        assert TYPE_MAP.get(f.dataType.simpleString()) == otypes[f.name], (f.name, f.dataType, otypes[f.name])
    assert got == _rows(res.fetchall(), ocols)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.oracle_sql())
