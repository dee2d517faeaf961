"""Every query with SQL gives what DuckDB gives; the others give rows with the same schema each time."""

import datetime
import decimal
import math

import duckdb
import pytest

from roadloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else round(v, 9)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_duckdb(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = ordered(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_same_schema_and_rows_each_time(spark, sf, name):
    one, two = (catalogue.QUERIES[name](spark, sf) for _ in range(2))
    assert one.columns and one.schema == two.schema and one.count() == two.count() > 0


def test_stream_and_batch_rules_agree(spark, sf):
    a = {r.dedup_key for r in catalogue.QUERIES["rule_engine_alerts"](spark, sf).collect()}
    b = {r.dedup_key for r in catalogue.QUERIES["stream_rules"](spark, sf).collect()}
    assert a and a == b
