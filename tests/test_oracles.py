"""Every registered query against its SQL oracle on the smallest test tables."""

import math
import os

import pytest

from vitrina.plans import ORACLES, QUERIES
from vitrina.plans.registry import TABLES

from conftest import TESTDATA

FOLDER = f"{TESTDATA}/sf{os.environ.get('TEST_SF', '0.001')}"
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def _cell(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, FOLDER)
    columns, types = sorted(df.columns), dict(df.dtypes)
    got = sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    assert {d[0]: str(d[1]) for d in res.description} == {c: SQL_TYPES[types[c]] for c in columns}
    order = [names.index(c) for c in columns]
    want = sorted(tuple(_cell(r[i]) for i in order) for r in res.fetchall())
    assert got == want


def test_every_operator_is_registered():
    families = {"t": 30, "l": 17, "m": 13, "j": 32, "i": 14, "a": 11, "w": 5, "v": 12, "u": 11, "s": 20, "p": 14, "x": 2}
    have = {n.split("_")[0] for n in QUERIES}
    missing = [f"{f}{i:02d}" for f, n in families.items() for i in range(1, n + 1) if f"{f}{i:02d}" not in have]
    assert missing == []
    assert set(ORACLES) <= set(QUERIES)
