"""Every query of the library runs at the smallest size and agrees with its SQL."""

import math

import duckdb
import pytest

from tidemark.plans import housing, layers  # noqa: F401  register their queries
from tidemark.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v.isoformat()[:10] if hasattr(v, "isoformat") else v


def key(row):
    return tuple((x is not None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    if name not in ORACLES:
        assert got
        return
    found = db.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=key)
