"""Every registered query against its DuckDB oracle on the smallest test scale."""

from __future__ import annotations

import collections
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from flightmart.plans.catalog import QUERIES
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["airline_name", "window_days", "revenue_direct", "revenue_agent"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


SPARK_TO_DUCK = {"StringType()": "VARCHAR", "LongType()": "BIGINT", "IntegerType()": "INTEGER",
                 "DoubleType()": "DOUBLE", "DateType()": "DATE", "TimestampNTZType()": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_column_types_match_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    spark_types = {f.name: SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType).replace("DecimalType", "DECIMAL"))
                   for f in df.schema.fields}
    rel = duck.sql(entry.oracle_sql()[name])
    assert spark_types == dict(zip(rel.columns, [str(t) for t in rel.types]))
