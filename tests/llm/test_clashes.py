"""Tables whose other columns are called like those that the operators add or use within."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.llm import cases
from weft.llm.line_dedup import dedup_lines
from weft.llm.mixing import mix
from weft.llm.substring_dedup import without_repeats
from weft.llm.work import Work, numbered, without_rows

NAMES = ("__uid", "__UID_", "__cut", "__lines", "__gone", "__removed", "size", "source_size", "target", "copies", "taken", "uid")


def clashing(spark):
    docs = cases.docs(spark).where("doc_id < 300 or doc_id >= 400").drop("uid")
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


def kept(df, added):
    """Rows with the columns that no operator adds."""
    names = [n for n in NAMES if n not in added]
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_lines(spark):
    docs, plain = clashing(spark), cases.docs(spark).where("doc_id < 300 or doc_id >= 400")
    found, want = dedup_lines(docs), dedup_lines(plain)
    assert sorted(found.columns) == sorted(docs.columns)
    assert sorted(map(repr, found.select("doc_id", "text", "__lines", "__gone").collect())) == sorted(map(repr, want.select("doc_id", "text", "__lines", "__gone").collect()))
    assert kept(found, ("__lines", "__gone")) == kept(docs, ("__lines", "__gone"))


def test_repeats(spark):
    docs = clashing(spark)
    found = without_repeats(docs, min_words=1)
    assert sorted(found.columns) == sorted(docs.columns) and dict(found.dtypes)["__removed"].startswith("array<")
    assert found.where("size(__removed) > 0").count() > 0 and kept(found, ("__removed",)) == kept(docs, ("__removed",))


def test_rows(spark):
    docs = Work(spark, "test").keep(clashing(spark))
    gone = numbered(docs, "place").where("doc_id = 50").select("place")
    left = without_rows(docs, gone, gone.count())
    assert left.columns == docs.columns and left.count() == docs.count() - 1 and left.where("doc_id = 50").isEmpty()


def test_mix(spark):
    docs, plain = clashing(spark), cases.docs(spark).where("doc_id < 300 or doc_id >= 400")
    shown = ("id", "size", "source_size", "target", "taken")
    assert sorted(map(repr, mix(docs).select(*shown).collect())) == sorted(map(repr, mix(plain).select(*shown).collect()))
