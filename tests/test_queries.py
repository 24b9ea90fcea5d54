"""Every query with an oracle against DuckDB on the smallest tables; the rest must run and give rows."""

import math

import duckdb
import pytest

from galley.plans import registry
from galley.session import TABLES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[p]) for p in places)) for r in result.fetchall())


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES
    assert set(registry.ORACLES) <= set(registry.QUERIES)
