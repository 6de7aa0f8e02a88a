"""The pipeline against a brute-force version of its rules on the smallest tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from weft.llm.decontaminate import normal_words
from weft.llm.line_dedup import lines_of
from weft.llm.work import Work

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages(spark):
    work, docs = Work(spark, "test"), spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(work.keep(stage(spark, steps[-1], FOLDER)))
    assert all(s.columns == columns for s in steps[:-1])
    raw, told, lined, unique, clean, mixed = ({r.doc_id: r for r in s.collect()} for s in steps)
    assert len(told) >= 0.98 * len(raw) and all(told[i].text == raw[i].text for i in told)

    where: dict[str, list] = {}
    for i in sorted(told):
        for k, line in enumerate(lines_of(told[i].text.encode())):
            if line:
                where.setdefault(line, []).append((i, k))
    groups: dict[int, list] = {}
    for line, root in zip(where, cases.components([{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in where]), strict=True):
        groups.setdefault(root, []).extend(where[line])
    gone = {o for g in groups.values() for o in sorted(g)[1:]}
    want = {}
    for i in told:
        parts = told[i].text.split("\n")
        left = "\n".join(x for k, x in enumerate(parts) if (i, k) not in gone)
        if left.strip() or not told[i].text.strip():
            want[i] = left
    assert {i: r.text for i, r in lined.items()} == want and all(r.n_chars == len(r.text) for r in lined.values())

    ids = sorted(lined)
    roots = cases.components([cases.shingles(lined[i].text) for i in ids])
    assert set(unique) == {i for k, i in enumerate(ids) if roots[k] == k}

    items = [normal_words(r.text.encode()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in items if w for k in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}

    def leaks(text):
        w = normal_words(text.encode())
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    assert set(clean) == {i for i, r in unique.items() if not leaks(r.text)}
    assert set(mixed) <= set(clean) and all(r.taken == r.copies * len(cases.spaced(r.text)) and 1 <= r.copies <= 3 for r in mixed.values())
    total = sum(len(cases.spaced(r.text)) for r in clean.values())
    assert abs(sum(r.taken for r in mixed.values()) - total) <= max(r.size for r in mixed.values())


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = Work(spark, "test").keep(stage(spark, docs, FOLDER))
        assert docs.count() == 0


def test_clashing_columns(spark):
    """Columns called like those that stages use within stay; those of the mixture are replaced."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60")
    for name in ("__uid", "__Gone", "__lines", "__cut", "uid", "size", "TARGET"):
        docs = docs.withColumn(name, F.lit("own"))
    work = Work(spark, "test")
    steps = [work.keep(docs)]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(work.keep(stage(spark, steps[-1], FOLDER)))
    assert all(s.columns == docs.columns for s in steps[:-1])
    last = steps[-1]
    assert last.columns == [c for c in docs.columns if c not in ("size", "TARGET")] + list(corpus_pipeline.MIXED)
    assert last.count() > 0 and last.where("__uid <> 'own' or __Gone <> 'own' or uid <> 'own'").isEmpty()
