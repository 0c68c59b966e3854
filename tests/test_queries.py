"""Every query of the catalog against its DuckDB twin, on the smallest driver tables."""

import decimal
import os

import duckdb
import pytest

from verilane.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver tables aren't here")


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)


def test_names_are_registered_once():
    import __spark_entry__ as entry

    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(entry.queries())
