"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as registry
from tidemill.learning.candidates import Sizes

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(rows, order):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return repr(v)

    return sorted([cell(row[i]) for i in order] for row in rows)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    expected = duck.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(expected.columns)
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {n: TYPES.get(t, t) for n, t in df.dtypes} == kinds
    found = canonical(df.collect(), [df.columns.index(n) for n in names])
    assert found == canonical(expected.fetchall(), [expected.columns.index(n) for n in names])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert registry.entry(spark).count() == 8


@pytest.mark.parametrize("name", ["ml_train_auto", "ml_train_classes", "ml_importance", "ml_predictions"])
def test_registered_training_has_full_sizes(spark, monkeypatch, name):
    class Reached(Exception):
        pass

    def caught(df, spec):
        assert spec.sizes == Sizes()
        raise Reached

    monkeypatch.setattr(registry, "train", caught)
    with pytest.raises(Reached):
        QUERIES[name](spark, SF_DIR)
