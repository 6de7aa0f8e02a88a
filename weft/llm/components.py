"""Distributed connected components by alternating large-star and small-star steps.

Each step groups the links of a node and ties its neighbours to the smallest of them, so the graph
turns into stars in a logarithmic number of rounds.  Minima are aggregated on the map side and
joined back, so a node with very many links is never gathered; links live in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.work import Work

#: Rounds after which something must be wrong; the method takes O(log^2 n).
MAX_ROUNDS = 64


def _large(e: DataFrame) -> DataFrame:
    """(u > v): every neighbour above a node is tied to the smallest in the node's neighbourhood."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """(u > v): a node and its smaller neighbours are tied to the smallest of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    ties = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ties.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(work: Work, links: DataFrame) -> DataFrame:
    """Nodes of ``links`` (two columns of longs, any order, repeats allowed) with ``component``, the smallest id reachable.

    Nulls and self-links say nothing and are left out.  No links: an empty result.
    """
    a, b = links.columns[:2]
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, seen = work.keep(e), None
    for _ in range(MAX_ROUNDS):
        # stars: no node is both above one and below another, and none has two parents
        n, parents, mark = e.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or mark == seen or (n == parents and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()):
            break
        seen = mark
        nxt = work.keep(_small(_large(e).distinct()))
        work.drop(e)
        e = nxt
    else:
        raise RuntimeError(f"components aren't complete after {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
