"""From raw documents to a training mixture: language, lines, near duplicates, benchmark passages, source weights.

Each stage is a function of (spark, docs, folder of the tables) to a DataFrame.  All but the last return the columns of
documents; what a stage drops or cuts is gone for the next one.  Further columns stay, whatever their names, but for those called like
one that the mixture adds (MIXED), which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import langid
from weft.llm.decontaminate import drop_contaminated
from weft.llm.jaccard_join import jaccard_components
from weft.llm.line_dedup import dedup_lines
from weft.llm.mixing import mix
from weft.llm.work import Work, free_name, numbered, without_rows

#: What the mixture says of a document.
MIXED = ("size", "source_size", "target", "copies", "taken")


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents without letters or without a language that is likely enough; sources stand for hosts."""
    work = Work(spark, "stage-language")
    found = langid.identify(docs, langid.train(docs), "doc_id", "text", "source")
    gone = work.keep(found.where("rejected").select("uid"))
    return without_rows(docs, gone, gone.count())


def dedup_similar_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Cuts lines that are similar to an earlier one; documents that lost all they had are dropped."""
    lines, gone = free_name(docs, "__lines"), free_name(docs, "__gone")
    kept = dedup_lines(docs, added=(lines, gone)).where((F.col(gone) == 0) | (F.col(gone) < F.col(lines)))
    return kept.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the document with the smallest id (null last, then row number) of each group of near duplicates."""
    work = Work(spark, "stage-jaccard")
    uid = free_name(docs, "__uid")
    found = work.keep(jaccard_components(numbered(docs, uid).select(uid, "text"), uid).where("id != component_id or n_shingles > 0").select("id", "component_id"))
    several = found.where("id != component_id").select("component_id").distinct()
    group = found.join(several, "component_id")
    ranked = group.join(numbered(docs, uid).select(F.col(uid).alias("id"), F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.col(uid).alias("uid")).alias("rank")), "id")
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("first"))
    gone = work.keep(ranked.join(first, "component_id").where("id != first.uid").select("id"))
    return without_rows(docs, gone, gone.count())


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents with any window of ten words of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mixture: each document taken, with how many copies of it and how many words that makes."""
    work = Work(spark, "stage-mix")
    uid = free_name(docs, "__uid")
    plan = work.keep(mix(docs).where("copies > 0").select(F.col("uid").alias(uid), *MIXED))
    return numbered(docs.drop(*MIXED), uid).join(plan, uid).drop(uid)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_similar_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Near duplicates and the language model have no equivalent in SQL; a test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
