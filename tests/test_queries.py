"""Every core query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from palimpsest.plans import queries

SRC = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in glob.glob(f"{SRC}/*.parquet"):
        db.execute(f"create view {Path(path).stem} as select * from read_parquet('{path}')")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(int(v)) if isinstance(v, Decimal) and v == v.to_integral_value() else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, SRC)
    columns = sorted(df.columns)
    found = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    assert found == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())


def test_sealing(spark):
    assert queries.QUERIES["seal_open_roundtrip"](spark, SRC).where("not same or same is null").isEmpty()
    assert queries.QUERIES["relocation_fails"](spark, SRC).where("not refused").isEmpty()


@pytest.mark.parametrize("name, source", [("wal_lsn", "orders"), ("batch_fetch", "events"), ("lookup_pages", "customer")])
def test_whole_tables(spark, name, source):
    assert queries.QUERIES[name](spark, SRC).count() == spark.read.parquet(f"{SRC}/{source}.parquet").count()
