"""Comparison of two catalogs with payload blocks: what differs, and whether it matters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks_class(blocks: DataFrame) -> DataFrame:
    """(model, name, kind, diff_blocks, total_blocks) from (model, name, dtype, ours_scale, ref_scale, same).

    A row is one block of both sides: its scales, and whether its bytes are equal.  Blocks that differ with both
    scales 0 are dead.  8-bit blocks that differ under one scale are genuine; else the scale rules differ, as in all other
    4-bit blocks.  Scales of 16-element blocks are bytes: NaN against the largest value, with equal codes, is a
    matter of the format.  Other types differ genuinely.
    """
    different = ~F.col("same")
    zero = (F.col("ours_scale") == 0) & (F.col("ref_scale") == 0)
    policy = F.col("codes_same") & F.expr("least(ours_scale, ref_scale) IN (126, 254) AND abs(ours_scale - ref_scale) = 1")
    sums = blocks.groupBy("model", "name", "dtype").agg(
        F.count_if(different).alias("diff_blocks"), F.count("*").alias("total_blocks"), F.bool_and(~different | zero).alias("dead"), F.bool_or(different & (F.col("ours_scale") == F.col("ref_scale"))).alias("one_scale"), F.bool_and(~different | policy).alias("policy")
    )
    kind = """CASE WHEN diff_blocks = 0 THEN 'byte_exact' WHEN dtype IN ('Q8_0', 'Q4_0') AND dead THEN 'dead_block' WHEN dtype = 'Q8_0' AND one_scale THEN 'genuine' WHEN dtype IN ('Q8_0', 'Q4_0') THEN 'scale_rule'
      WHEN dtype = 'NVFP4' AND policy THEN 'format_conformance' ELSE 'genuine' END"""
    return sums.select("model", "name", F.expr(kind).alias("kind"), "diff_blocks", "total_blocks")


def compare(ours: DataFrame, ref: DataFrame) -> DataFrame:
    """(model, name, class) for every name of either side (model, name, dtype, d0, d1, digest), F32 tensors aside."""
    a, b = (x.select("model", "name", *[F.col(c).alias(f"{c}_{s}") for c in ("dtype", "d0", "d1", "digest")]) for x, s in ((ours, "o"), (ref, "r")))
    both = a.join(b, ["model", "name"], "full_outer")
    kind = """CASE WHEN dtype_r IS NULL THEN 'ours_only' WHEN dtype_o IS NULL THEN 'ref_only' WHEN dtype_o = 'F32' OR dtype_r = 'F32' THEN 'skipped_f32' WHEN dtype_o <> dtype_r THEN 'dtype_mismatch'
      WHEN NOT (d0_o <=> d0_r AND d1_o <=> d1_r) THEN 'dims_mismatch' WHEN digest_o = digest_r THEN 'byte_exact' ELSE 'different' END"""
    return both.select("model", "name", F.expr(kind).alias("class"))


def decision(ratios: DataFrame, least_wins: int = 3, worst: float = 0.01, gain: float = 0.02) -> DataFrame:
    """(candidate, adopted) from (candidate, profile, base, new): enough profiles improve, none gets much worse, and all gain."""
    per = ratios.groupBy("candidate", "profile").agg(F.sum("base").alias("b"), F.sum("new").alias("n"))
    out = per.groupBy("candidate").agg(F.count_if(F.col("n") < F.col("b")).alias("wins"), F.max(F.expr("n / b - 1")).alias("worst"), F.expr("1 - sum(n) / sum(b)").alias("gain"))
    return out.withColumn("adopted", F.expr(f"wins >= {least_wins} AND worst <= {worst} AND gain >= {gain}"))
