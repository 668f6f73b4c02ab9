"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

from gazetta import plans

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no driver tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", [*plans.QUERIES])
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, str(DATA))
    got = df.collect()
    if name in plans.ORACLES:
        want = duck.sql(plans.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert table(df.columns, got) == table(want.columns, want.fetchall())


def test_the_driver_contract(spark):
    import __spark_entry__ as entry

    if DATA.exists():
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())
