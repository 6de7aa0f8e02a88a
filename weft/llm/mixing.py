"""Mixing sources to target weights by weighted fair queueing.

Every document stands in its source's queue, in an order shuffled by a hash.  Its virtual finish time is the
source's cumulative words up to its middle, in this and earlier passes of the queue, divided by the source's target.
All copies are range-sorted by finish time and taken until the budget is used up.  As time runs to the middle of a
document, a source ends within half a document of its target, be its last document long or short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.work import Work, running_total, session_of, steady

#: Weights of the sources by rank, repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken at most so often, and a source's target is at most so many times its size.
REPEATS = 3
#: Of products of two of these, all digits fit in a decimal.
_WHOLE = "decimal(19,0)"


def size_of(text_col: str):
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(work: Work, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, rank, source_size, start, target) from (source, source_size); start is the size of lower ranks.

    Shares of the total are in proportion to the weights; a source whose share is above ``repeats`` times its size
    gets that, and the rest is shared again until none is above.  All comparisons are of whole numbers.
    """
    ranked = sizes.withColumn("one", F.lit(1).cast("long")).withColumn("last", F.col("source").isNull())
    ranked = running_total(work, ranked, ["last", "source"], "one", "rank")
    ranked = running_total(work, ranked.drop("one"), ["rank"], "source_size", "start")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = work.keep(ranked.select("source", "rank", "source_size", (F.col("start") - F.col("source_size")).alias("start"), weight.alias("w")))
    total, left_w = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    total, left_w = total or 0, left_w or 0
    left, above = total, F.lit(False)
    while left_w:
        now = F.col("w").cast(_WHOLE) * F.lit(left).cast(_WHOLE) > F.col("source_size").cast(_WHOLE) * F.lit(repeats * left_w).cast(_WHOLE)
        size, w = ranked.agg(F.sum(F.when(now, F.col("source_size"))), F.sum(F.when(~now, F.col("w")))).first()
        above, rest = now, (total - repeats * (size or 0), w or 0)
        if rest == (left, left_w):
            break
        left, left_w = rest
    share = (F.col("w") * F.lit(left)).cast("double") / F.lit(max(left_w, 1))
    return ranked.select("source", "rank", "source_size", "start", F.when(above, (F.col("source_size") * repeats).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(uid, id, source, size, source_size, target, copies, taken) for every row of ``docs``; the budget is the total size.

    ``uid`` is the row's number in the input.
    Size is the number of white-space-separated words (null text: 0).  Sources are ranked by code point, null last and a
    source like any other.  The order within a source is by md5 of the id (null: empty), then id, then size, so reruns
    agree and rows that repeat an id stand beside each other; each is mixed on its own.  Empty texts are never
    taken; an empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    work = Work(session_of(docs), "mix")
    rows = steady(work, docs).select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(text_col).alias("size"))
    rows = work.keep(rows.withColumn("uid", F.monotonically_increasing_id()))
    sources = work.keep(targets(work, rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats))
    sources = sources.withColumnRenamed("source", "name")
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["name"])).drop("source")
    rows = rows.withColumn("shuffled", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    queued = running_total(work, rows, ["rank", "shuffled", "id", "size"], "size", "cum").drop("shuffled")
    copies = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = (2 * (F.col("cum") - F.col("start") + F.col("pass") * F.col("source_size")) - F.col("size")).cast("double") / (2 * F.col("target"))
    copies = copies.select("uid", "id", "name", "size", "source_size", "target", "rank", "cum", "pass", F.when(F.col("target") > 0, finish).otherwise(F.lit(float("inf"))).alias("finish"))
    budget = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    lined = running_total(work, copies, ["finish", "rank", "cum", "pass"], "size", "total")
    taken = (2 * F.col("total") - F.col("size") <= F.lit(2 * budget)).cast("long")
    out = lined.groupBy("uid").agg(*[F.first(c).alias(c) for c in ("id", "name", "size", "source_size", "target")], F.sum(taken).alias("copies"))
    return out.select("uid", "id", F.col("name").alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS BIGINT) AS w, CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM s
), k AS (
  SELECT *, CAST(budget - 3 * coalesce(sum(source_size) OVER before, 0) AS BIGINT) AS left_b,
    CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS BIGINT) AS left_w
  FROM w WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, w * left_b > 3 * source_size * left_w AS above FROM k
), l AS (
  SELECT max_by(left_b, left_w) FILTER (WHERE NOT above) AS b, max(left_w) FILTER (WHERE NOT above) AS lw FROM c
), t AS (
  SELECT source, rank, source_size, CASE WHEN above THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * b AS DOUBLE) / lw END AS target FROM c, l
), q AS (
  SELECT d.doc_id, d.size, t.*EXCLUDE (source), sum(d.size) OVER (PARTITION BY t.rank ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum,
    row_number() OVER (ORDER BY d.doc_id) AS uid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT *, CAST(2 * (cum + pass * source_size) - size AS DOUBLE) / (2 * target) AS finish FROM q, (SELECT unnest([0, 1, 2]) AS pass)
), r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, cum, pass ROWS UNBOUNDED PRECEDING) AS total FROM f
)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  CAST(any_value(size) * count(*) FILTER (WHERE 2 * total - size <= 2 * (SELECT max(budget) FROM w)) AS BIGINT) AS taken
FROM r GROUP BY uid, doc_id
"""
