"""The driver contract: every query against its oracle on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from weft import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in sorted(os.listdir(FOLDER)):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{t}'")
    return con


def plain(x):
    return repr(round(x, 9)) if isinstance(x, float) else repr(x)


#: One policy of each engine is enough here.
NAMES = [n for n in queries.QUERIES if not n.startswith("policy_") or n in ("policy_q4_k_m", "policy_q2_k_l", "policy_iq3_m", "policy_overrides")]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in entry.oracle_sql():
        assert got
        return
    found = duck.sql(entry.oracle_sql()[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns and got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
