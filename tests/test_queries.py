"""Every registered query of the engine's own operators runs; those with SQL equal DuckDB on the same tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from marlstone.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = [[plain(r[c]) for c in sorted(df.columns)] for r in df.collect()]
    r = con.execute(ORACLES[name])
    cols = [d[0] for d in r.description]
    want = [[plain(row[cols.index(c)]) for c in sorted(cols)] for row in r.fetchall()]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).collect() is not None
