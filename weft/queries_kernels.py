"""Queries of rotations, searches, bias correction, casts and container round trips over ``embeddings``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import kernels as X
from weft.operators import quantize as Q
from weft.operators.superblocks import KINDS, superblocks
from weft.queries_quantize import _NV_ORACLE, LONG, int8_oracle, matrix, shown, shown_slices, wide
from weft.registry import query

# The matrix rotated in groups of 16 columns: signs are products of those of the 4 x 4 matrix, sums of 16 floats are exact in doubles.
_SIGN = "(CASE WHEN {0} // 4 + {1} // 4 = 3 THEN -1 ELSE 1 END * CASE WHEN {0} % 4 + {1} % 4 = 3 THEN -1 ELSE 1 END)"
_ROTATED = LONG.replace("WITH e AS (", "WITH e0 AS (", 1).replace(
    "), t AS (",
    f"), e AS (SELECT tensor, row_id, i // 16 * 16 + j AS i, r, CAST(sum(CAST(x AS DOUBLE) * {_SIGN.format('(i % 16)', 'j')} / 4) AS FLOAT) AS x FROM e0, (SELECT unnest(range(16)) AS j) GROUP BY tensor, row_id, i // 16, j, r), t AS (",
    1,
)


@query("rotate_16", f"{_ROTATED} SELECT tensor, row_id, i, CAST(x AS DOUBLE) AS x FROM e")
def rotate_16(spark: SparkSession, folder: str) -> DataFrame:
    rows = X.rotated(matrix(spark, folder), 16)
    return rows.select("tensor", "row_id", F.posexplode("v").alias("i", "x")).select("tensor", "row_id", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


@query("rotated_int8", int8_oracle("row").replace(LONG, _ROTATED))
def rotated_int8(spark: SparkSession, folder: str) -> DataFrame:
    return shown(Q.int8_row(X.rotated(matrix(spark, folder), 16)))


@query("rotated_nvfp4", _NV_ORACLE.replace(LONG, _ROTATED))
def rotated_nvfp4(spark: SparkSession, folder: str) -> DataFrame:
    return shown_slices(Q.nvfp4(X.rotated(matrix(spark, folder), 16)), 16)


@query("rotation_incoherence", f"{_ROTATED} SELECT tensor, round(max(CAST(abs(x) AS DOUBLE)) * sqrt(count(*)) / sqrt(sum(CAST(x AS DOUBLE) * x)), 6) AS gamma FROM e GROUP BY tensor")
def rotation_incoherence(spark: SparkSession, folder: str) -> DataFrame:
    return Q.incoherence(X.rotated(matrix(spark, folder), 16)).select("tensor", F.round("gamma", 6).alias("gamma"))


@query("nvfp4_scale_search")
def nvfp4_scale_search(spark: SparkSession, folder: str) -> DataFrame:
    """Scale bytes and the tensor's scale by least squared error, in three rounds; never more than the usual scales lose."""
    rows = matrix(spark, folder)
    scales = Q.with_tensor_max(rows).groupBy("tensor").agg(F.expr("max(CAST(amax AS DOUBLE)) / 2688").alias("tensor_scale"))
    return X.scale_search(rows, scales).select("tensor", "row_id", F.array_join(F.col("bytes").cast("array<string>"), ",").alias("bytes"), "error", "tensor_scale")


@query("bias_correction")
def bias_correction(spark: SparkSession, folder: str) -> DataFrame:
    rows = matrix(spark, folder)
    biases = rows.select("tensor", "row_id", F.expr("CAST(row_id AS FLOAT) / 1000").cast("float").alias("bias"))
    return X.bias_correction(rows, Q.int8_dequantize(Q.int8_row(rows)), biases)


@query("iq4_nl_blocks")
def iq4_nl_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of 32 on 16 uneven levels."""
    from collections.abc import Iterator

    import pyarrow as pa

    from weft.session import ship_package

    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = X._rows(batch).astype(np.float64)
                scale, codes = X.iq4_nl(x.reshape(-1, 32))
                n = x.shape[1] // 32
                slices = pa.array(np.tile(np.arange(n), len(x)), pa.int32())
                at = pa.array(np.repeat(np.arange(len(x)), n))
                text = pa.array([",".join(map(str, c)) for c in codes.tolist()])
                yield pa.RecordBatch.from_arrays([batch.column("tensor").take(at), batch.column("row_id").take(at), slices, pa.array(scale), text], ["tensor", "row_id", "slice", "scale", "codes"])

    return matrix(spark, folder).mapInArrow(run, "tensor int, row_id long, slice int, scale double, codes string")


def _superblocks(kind: str, weighted: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = wide(spark, folder)
        weights = rows.groupBy("tensor").agg(F.expr("transform(max_by(v, -row_id), x -> CAST(0.1 AS FLOAT) + abs(x))").alias("w")) if weighted else None
        return superblocks(rows, kind, weights, fill=True).select("tensor", "row_id", F.hex("data").alias("data"))  # the last row may be short

    run.__name__ = f"{kind}_{'weighted' if weighted else 'blocks'}"
    run.__doc__ = f"Super-blocks of the layout {kind}" + (", errors weighted by column." if weighted else ".")
    return run


for _kind in KINDS:
    for _weighted in (False, True):
        _run = _superblocks(_kind, _weighted)
        query(_run.__name__)(_run)
