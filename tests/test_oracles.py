"""Every registered query against its SQL twin; those of the optional part have their own tests."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_DIR

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(map(plain, r)) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = entry.QUERIES[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(entry.ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(entry.QUERIES) - set(entry.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
