"""Every query with SQL gives the rows of that SQL on the small tables; the others run and keep their schema."""

import glob
import math
import os

import duckdb
import pytest

from sonarium.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T", " ")
    return v


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in registry.ORACLE:
        assert got
        return
    want = duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(list(want.columns), want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
