"""Vectors in all directions alike, which no bound tells apart."""

import numpy as np
import pyarrow as pa

from weft.llm import embedding_dedup
from weft.llm.embedding_dedup import near_vectors
from weft.llm.work import Work


def brute(ids, x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    root = ids.copy()
    for _ in ids:
        root = np.array([root[row].min() for row in linked])
    return dict(zip(ids.tolist(), zip((linked.sum(axis=1) - 1).tolist(), root.tolist(), strict=True), strict=True))


def some(n: int, seed: int = 1) -> np.ndarray:
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 16))
    x[: n // 2] = x[r.integers(n // 2, n, n // 2)] + r.normal(size=(n // 2, 16)) * 0.15  # near copies, not all linked
    return x


def test_replicas_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 20)
    dealt, keep = [], Work.keep

    def kept(work, df):
        out = keep(work, df)
        dealt.extend([out] if "cells" in df.columns else [])
        return out

    monkeypatch.setattr(Work, "keep", kept)
    x, ids = some(600), np.random.default_rng(2).permutation(600)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id) for r in near_vectors(rows).collect()}
    assert got == brute(ids, x)
    (only,) = dealt
    assert only.selectExpr("avg(size(cells))").first()[0] <= 1.25 * embedding_dedup.REPLICAS


def test_links_of_a_block_are_the_same_in_parts(monkeypatch):
    x, ids = some(300), np.random.default_rng(3).permutation(300)
    sides = [{"reps": ids[a:b].tobytes(), "mults": np.ones(b - a, np.int64).tobytes(), "x": x[a:b].tobytes()} for a, b in ((0, 170), (170, 300))]
    alone, both = ({"dim": 16, **{f"{c}{i + 1}": s and s[c] for i, s in enumerate(pair) for c in ("reps", "mults", "x")}} for pair in ((sides[0], None), sides))
    schema = pa.schema([("dim", pa.int32()), *[(f"{c}{i}", pa.binary()) for i in (1, 2) for c in ("reps", "mults", "x")]])
    batch = pa.RecordBatch.from_pylist([alone, both], schema)
    whole = [b.to_pylist() for b in embedding_dedup._compare(0.95)(iter([batch]))]
    monkeypatch.setattr(embedding_dedup, "MATRIX", 256)
    assert whole == [b.to_pylist() for b in embedding_dedup._compare(0.95)(iter([batch]))]
    true = brute(ids[:170], x[:170])
    assert {r["rep"]: (r["links"], r["root"]) for r in whole[0]} == {k: v for k, v in true.items() if v[0]}
