"""Matrices whose rows don't fill the last tile or super-block, against SQL and the encoders."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from weft.operators.superblocks import KINDS, SIZE, decode, encode, superblocks


def against_sql(spark, folder, name):
    """Rows of the query and of its SQL over the Parquet tables of ``folder``, both as text and in order."""
    con = duckdb.connect()
    for t in sorted(os.listdir(folder)):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{t}{'/*.parquet' if os.path.isdir(f'{folder}/{t}') else ''}')")
    df = entry.queries()[name](spark, folder)
    found = con.sql(entry.oracle_sql()[name])
    at = [found.columns.index(c) for c in df.columns]
    return sorted(map(repr, map(tuple, df.collect()))), sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def vectors(spark, folder, ids):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=64)], i % 3) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return rows


@pytest.mark.parametrize("ids", [range(9), [0, 1, 2, 5, 6, 21]])
@pytest.mark.parametrize("name", ["int8_block_quantize", "int8_clip_block", "fp8_block_quantize"])
def test_tiles_at_the_edge(spark, tmp_path, name, ids):
    vectors(spark, str(tmp_path), ids)
    got, want = against_sql(spark, str(tmp_path), name)
    assert got == want and got


@pytest.mark.parametrize("kind", KINDS)
def test_rows_short_of_a_superblock(spark, tmp_path, kind):
    rows = vectors(spark, str(tmp_path), range(10))
    x = np.zeros((3, SIZE), np.float32)
    x.reshape(-1)[:640] = np.concatenate([v for _, v, _ in rows])
    for name in (f"{kind}_blocks", f"{kind}_weighted"):
        got = entry.queries()[name](spark, str(tmp_path)).orderBy("row_id").collect()
        back = decode(kind, np.stack([np.frombuffer(bytes.fromhex(r.data), np.uint8) for r in got]))
        assert back.shape == x.shape and ((back - x) ** 2).sum() < 0.2 * (x**2).sum()
        assert (back[2, 128:] == 0).all() and ((back[2] - x[2]) ** 2).sum() < 0.2 * (x[2] ** 2).sum()
    assert got[0].data == encode(kind, x[:1], np.float32(0.1) + np.abs(x[:1])).tobytes().hex().upper()
    short = spark.createDataFrame([("t", 0, x[2, :128].tolist())], "tensor string, row_id long, v array<float>")
    weights = spark.createDataFrame([("t", [1.0] * 128)], "tensor string, w array<float>")
    assert bytes(superblocks(short, kind, weights, fill=True).first().data) == encode(kind, x[2:], np.repeat(np.float32([[1, 0]]), 128, axis=1)).tobytes()
