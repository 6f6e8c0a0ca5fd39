"""Every registered query with an oracle agrees with DuckDB on the same tables."""

import math

import duckdb
import pytest

from kelora import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v if isinstance(v, (int, bool, type(None))) else str(v)


def place(row):
    """Rows are paired by values that noise in the last digits does not move."""
    return repr([round(x, 4) if isinstance(x, float) else x for x in row]), repr(row)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cur = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=place)
    want = sorted((tuple(value(r[names.index(c)]) for c in cols) for r in want), key=place)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 1e-6 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_oracle_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
