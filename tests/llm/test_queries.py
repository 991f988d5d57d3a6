"""Queries of the llm problems against their SQL at the smallest scale, and the schemas of the others."""

import glob
import os
from pathlib import Path

import duckdb
import pytest

from wardline.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return c


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool) or hasattr(v, "is_integer") and float(v).is_integer():
        return repr(float(v))
    if isinstance(v, float):
        return f"{v:.9g}"
    return repr(float(v)) if isinstance(v, int) else str(v).removesuffix("+00:00")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    schema = {"p6_ids": "struct<doc_id:bigint,ids:array<int>>", "p7_found": "struct<item_id:bigint,doc_id:bigint>", "p8_found": "struct<doc_id:bigint,band:string>"}
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0
    assert name not in schema or df.schema.simpleString() == schema[name]
