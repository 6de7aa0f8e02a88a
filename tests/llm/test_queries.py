"""Every registered query of the operators on the smallest tables: columns, types, contracts, and SQL where there is some."""

from __future__ import annotations

import os
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from weft.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int, n_offending int, offending string",
    "op2_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, text_sha256 string",
    "op3_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op4_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op6_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op8_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op10_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else repr(x)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in COLUMNS:
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) == COLUMNS[name]
    rows = df.collect()
    con = duckdb.connect()
    for t in sorted(os.listdir(FOLDER)):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{t}'")
    whole = {"op4_embedding_near_dedup": "embeddings", "op9_language_id": "pages"}.get(name, "documents")
    if not name.startswith(("op5", "op7")):
        assert len(rows) == con.sql(f"SELECT count(*) FROM {whole}").fetchall()[0][0]
    if "held_out" in df.columns:
        mod, rest = (3, 1) if name.startswith("op1") else (7, 2)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows)
    if "predicted" in df.columns:
        assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    if "kept" in df.columns and whole == "embeddings":
        v = np.array([x[0] for x in con.sql("SELECT embedding FROM embeddings ORDER BY vec_id").fetchall()], float)
        v /= np.linalg.norm(v, axis=1)[:, None]
        linked = v @ v.T >= 0.95
        assert all(r.kept == (r.vec_id == r.component_id) and r.n_links == linked[r.vec_id].sum() - 1 for r in rows)
    if name in entry.oracle_sql():
        found = con.sql(entry.oracle_sql()[name])
        columns = sorted(df.columns)
        at = [found.columns.index(c) for c in columns]
        assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_toxicity_on_held_out_rows(spark):
    """On the rows whose labels weren't seen: toxic texts rank above others, and few others are predicted."""
    folder = FOLDER.replace("0.001", "0.01")
    got = entry.queries()["op1_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = ([r.score for r in got if r.toxic == x] for x in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) >= 0.95
    assert sum(r.toxic for r in got if r.predicted) >= 0.9 * sum(r.predicted for r in got) > 0


def test_language_of_plain_texts(spark):
    """Accuracy on documents that the model didn't learn from."""
    from pyspark.sql import functions as F

    from weft.llm import langid

    docs = spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/documents.parquet").where("n_chars > 100")
    held = F.pmod(F.col("doc_id"), F.lit(2)) == 0
    got = langid.identify(docs.where(held), langid.train(docs.where(~held)), "doc_id", "text", None).withColumnRenamed("id", "doc_id")
    got = got.join(docs.select("doc_id", F.col("lang").alias("said")), "doc_id").collect()
    assert np.mean([r.lang == r.said for r in got]) >= 0.95
