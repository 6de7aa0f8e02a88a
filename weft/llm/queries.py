"""The registered queries of this subpackage: each applies one operator to its whole table.

``QUERIES`` maps a name to a function of (spark, folder); ``ORACLES`` maps a name to DuckDB SQL for the same
rows, for those queries that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import langid, toxicity
from weft.llm.decontaminate import DECONTAMINATE_SQL, find_contamination
from weft.llm.embedding_dedup import near_vectors
from weft.llm.jaccard_join import jaccard_components
from weft.llm.line_dedup import dedup_lines
from weft.llm.lm_score import score_texts
from weft.llm.mixing import MIX_SQL, mix
from weft.llm.secret_findings import labelled_findings
from weft.llm.secrets_scan import find_secrets
from weft.llm.substring_dedup import REPEATS_SQL, repeated_units

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Noisy-or toxicity of documents; a third of the ids is held out of training."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.where(toxicity.remainder("doc_id", 3) != 1))
    held_out = F.coalesce(toxicity.remainder("doc_id", 3) == 1, F.lit(False))
    found = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), F.to_json("offending").alias("offending"))


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents after fuzzy line deduplication: lines, lines removed, and a digest of the text that is left."""
    found = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return found.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"), digest.alias("text_sha256"))


@query
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of documents in any 10-word window of a benchmark item."""
    found = find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of vectors with cosine similarity of at least 0.95."""
    found = near_vectors(table(spark, folder, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


@query
def op5_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of sentences that stand in an earlier document, or earlier in the same one."""
    found = repeated_units(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "end", "n_units", "n_words", F.col("kept_id").alias("kept_doc_id"), "kept_start")


@query
def op5_repeated_units(spark: SparkSession, folder: str) -> DataFrame:
    """All runs of sentences that stand in an earlier document, or earlier in the same one, however short."""
    found = repeated_units(table(spark, folder, "documents"), min_words=1)
    return found.select(F.col("id").alias("doc_id"), "start", "end", "n_units", "n_words", F.col("kept_id").alias("kept_doc_id"), "kept_start")


@query
def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents with 5-word-shingle Jaccard similarity of at least 0.8."""
    return jaccard_components(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates for secrets in documents and which of them are kept."""
    return find_secrets(table(spark, folder, "documents"), labelled_findings()).withColumnRenamed("id", "doc_id")


@query
def op8_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probabilities of documents; a seventh of the ids is held out of training."""
    found = score_texts(table(spark, folder, "documents"), toxicity.remainder("doc_id", 7) != 2)
    return found.withColumnRenamed("id", "doc_id").withColumn("training", ~F.col("training")).withColumnRenamed("training", "held_out")


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of pages, by models of the languages of documents."""
    model = langid.train(table(spark, folder, "documents"))
    found = langid.identify(table(spark, folder, "pages"), model, "page_id", "html", "url", pages=True)
    return found.select(F.col("id").alias("page_id"), "host", "lang", "confidence", "rejected")


@query
def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents mixed to the target weights of their sources, with a budget of all words."""
    found = mix(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLES |= {"op3_decontaminate": DECONTAMINATE_SQL, "op5_repeated_passages": REPEATS_SQL, "op10_mix_sources": MIX_SQL}
