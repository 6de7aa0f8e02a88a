"""Block-wise quantization of matrix rows (tensor, row_id, v ARRAY<FLOAT>).

A scheme aggregates the largest magnitude of a tensor, row, tile or slice into a scale, then encodes in Arrow batches (dense.py):
Spark puts an array expression's inputs into its lambdas, so that a row's maximum would be taken again for each element.
Slice schemes are one pass without a shuffle; tile schemes shuffle the rows once by (tensor, tile row); the others don't.
Results have ``scales`` (one for each slice, or one) as doubles and ``codes`` as integers, one for each element.
The maxima of the 8-bit formats and of block formats leave NaN out, those of the 4-bit float format don't.  Elements that
aren't a number after scaling have integer code 0, E4M3 code 127 and E2M1 code 4.  A tensor of zeros has scale 1 in 8-bit formats.
Tensor-wide facts (largest magnitude, all zeros, shape) are one row for each tensor, joined back; broadcast if the tensors are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import numeric as N
from weft.operators import dense

TINY = "CAST(1e-12 AS FLOAT)"


def amax(v: str = "v") -> str:
    return f"coalesce(array_max(transform(filter({v}, x -> not isnan(x)), x -> abs(x))), CAST(0 AS FLOAT))"


def slices(v: str, size: int) -> str:
    """The array's slices of ``size`` elements (the last may be shorter)."""
    return f"transform(sequence(0, CAST((size({v}) - 1) div {size} AS INT)), b -> slice({v}, CAST(b * {size} + 1 AS INT), {size}))"


#: Result columns of the kernels.
CODED = {"scales": "array<double>", "codes": "array<int>"}
VALUED = CODED | {"values": "array<double>"}


def with_tensor_max(rows: DataFrame) -> DataFrame:
    """(tensor, row_id, v) with the tensor's largest magnitude ``amax``, whether it holds a NaN (``nan``) and whether it is all zeros (``zeros``)."""
    return dense.with_facts(rows)


def int8_tensor(rows: DataFrame, clip: float | None = None) -> DataFrame:
    """One scale for a tensor: largest magnitude / 127."""
    return dense.encode(with_tensor_max(rows), dense.int8_tensor(clip), CODED)


def int8_row(rows: DataFrame, clip: float | None = None) -> DataFrame:
    """One scale for a row: the reciprocal of 127 * (1 / largest magnitude), in 32-bit steps; 1 in a tensor of zeros."""
    return dense.encode(with_tensor_max(rows), dense.int8_row(clip), CODED)


def int8_block(rows: DataFrame, size: int = 128, clip: float | None = None, partial: bool = False) -> DataFrame:
    """One scale for a size x size tile: largest magnitude / 127, at least 1e-8; a tensor whose rows or columns don't divide is an error.

    With ``partial`` it is none: tiles at the edges, or with rows missing, have a scale for the elements that they have.
    """
    if partial:
        return dense.encode_tiles(dense.with_facts(rows), size, dense.int8_block(size, clip), CODED)
    refused = F.raise_error(F.concat(F.lit("rows and columns must be multiples of "), F.lit(str(size)), F.lit(": tensor "), F.col("tensor").cast("string")))
    shaped = dense.with_facts(rows, size)
    shaped = shaped.withColumn("v", F.when(F.col("whole"), F.col("v")).otherwise(refused.cast(shaped.schema["v"].dataType)))
    return dense.encode_tiles(shaped, size, dense.int8_block(size, clip), CODED)


def int8_dequantize(quantized: DataFrame, size: int | None = None) -> DataFrame:
    """(tensor, row_id, v): code times scale; ``size`` is the tile size of tile schemes."""
    at = f"scales[CAST(i div {size} AS INT)]" if size else "scales[0]"
    return quantized.select("tensor", "row_id", F.expr(f"transform(codes, (c, i) -> {N.f32(f'c * {at}')})").alias("v"))


def fp8_tensor(rows: DataFrame) -> DataFrame:
    return dense.encode(with_tensor_max(rows), dense.fp8_tensor, VALUED)


def fp8_row(rows: DataFrame) -> DataFrame:
    return dense.encode(with_tensor_max(rows), dense.fp8_row, VALUED)


def fp8_block(rows: DataFrame, size: int = 128, partial: bool = False) -> DataFrame:
    """One scale for a size x size tile; a tensor whose rows or columns don't divide gets one for each row (one, if it is all zeros).

    With ``partial`` it gets tiles too: those at the edges, or with rows missing, have a scale for the elements that they have.
    """
    return dense.encode_tiles(dense.with_facts(rows, None if partial else size), size, dense.fp8_block(size), VALUED)


def fp8_dequantize(quantized: DataFrame, size: int | None = None) -> DataFrame:
    """Tile schemes multiply by the stored scale; tensor and row schemes divide by its reciprocal, taken again in 32 bits."""
    x = N.mul("x", f"scales[if(size(scales) = 1, 0, CAST(i div {size} AS INT))]") if size else N.div("x", N.inverse("scales[0]"))
    return quantized.select("tensor", "row_id", F.expr(f"transform(values, (x, i) -> {x})").alias("v"))


def mxfp8(rows: DataFrame, compensate: float = 1.0) -> DataFrame:
    """A power-of-two scale (its exponent byte) for 32 elements, which are E4M3; the input is rounded to bf16 first."""
    return dense.encode(rows.select("tensor", "row_id", "v"), dense.mxfp8(compensate), VALUED | {"n": "int"})


def mxfp8_dequantize(quantized: DataFrame) -> DataFrame:
    value = f"{N.f32(f'x * {N.e8m0_value("scales[CAST(i div 32 AS INT)]")}')}"
    return quantized.select("tensor", "row_id", F.expr(f"slice(transform(values, (x, i) -> {value}), 1, n)").alias("v"))


def nvfp4(rows: DataFrame) -> DataFrame:
    """A scale for the tensor, an E4M3 scale for 16 elements, which are E2M1 nibbles; the input is rounded to bf16 first.

    ``scales`` are the slices' scale bytes, ``tensor_scale`` the tensor's.  Where a tensor is all zeros its scale is 0 and
    the slices' 0 / 0 is NaN, byte 127; a NaN makes the tensor's scale NaN.  Elements over a scale that is NaN have code 4, as
    the format has it for what isn't a number.
    """
    columns = CODED | {"tensor_scale": "double", "totals": "array<float>", "n": "int"}
    return dense.encode(with_tensor_max(rows), dense.nvfp4, columns)


def nvfp4_dequantize(quantized: DataFrame) -> DataFrame:
    value = N.mul(N.e2m1_value("c"), "totals[CAST(i div 16 AS INT)]")
    return quantized.select("tensor", "row_id", F.expr(f"slice(transform(codes, (c, i) -> {value}), 1, n)").alias("v"))


def pack_nibbles(codes: str = "codes") -> str:
    """Bytes of nibbles two by two, the first one high."""
    return f"transform(sequence(0, CAST(size({codes}) div 2 - 1 AS INT)), k -> shiftleft({codes}[k * 2], 4) | {codes}[k * 2 + 1])"


def swizzled(row: str, col: str, cols: str) -> str:
    """Place of the scale at (row, col) in tiles of 128 x 4, themselves in row order; ``cols`` is the padded width."""
    tile = f"(floor({row} / 128) * floor({cols} / 4) + floor({col} / 4))"
    return f"CAST({tile} * 512 + ({row} % 32) * 16 + floor(({row} % 128) / 32) * 4 + {col} % 4 AS BIGINT)"


def errors(rows: DataFrame, decoded: DataFrame) -> DataFrame:
    """(tensor, squared_error, squared_norm, relative, largest) of decoded rows against the originals, in doubles."""
    both = rows.join(decoded.select("tensor", "row_id", F.col("v").alias("w")), ["tensor", "row_id"])
    both = both.select("tensor", F.expr("aggregate(zip_with(v, w, (a, b) -> pow(CAST(a AS DOUBLE) - b, 2)), 0D, (s, x) -> s + x)").alias("e"), F.expr("aggregate(v, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)").alias("n"), F.expr("array_max(zip_with(v, w, (a, b) -> abs(CAST(a AS DOUBLE) - b)))").alias("d"))
    return both.groupBy("tensor").agg(F.sum("e").alias("squared_error"), F.sum("n").alias("squared_norm"), F.max("d").alias("largest")).withColumn("relative", F.expr("squared_error / nullif(squared_norm, 0)"))


def incoherence(rows: DataFrame) -> DataFrame:
    """(tensor, frobenius, top, gamma): largest magnitude over the norm, times the root of the number of elements; null for zero."""
    sums = rows.groupBy("tensor").agg(F.sum(F.expr("aggregate(v, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)")).alias("ss"), F.max(F.expr(N.f64(amax()))).alias("top"), F.sum(F.size("v")).alias("n"))
    return sums.select("tensor", F.sqrt("ss").alias("frobenius"), "top", F.expr("top * sqrt(n) / nullif(sqrt(ss), 0)").alias("gamma"))


def f16(x: str) -> str:
    """Value of a double rounded to 11 significant bits, ties to even, down to steps of 2**-24; infinite from 65520 on, NaN stays NaN."""
    q = N.two_to(f"greatest({N.exponent(f'greatest(abs({x}), {N.two_to("-40")})')}, -14) - 10")
    return f"(CASE WHEN isnan({x}) THEN {N.NAN} WHEN abs({x}) >= 65520 THEN sign({x}) * {N.INFINITE} ELSE rint(({x}) / ({q})) * ({q}) END)"


def q8_0(rows: DataFrame) -> DataFrame:
    """(tensor, row_id, slice, scale, codes): 32 elements with a half-precision scale; halves round away from zero."""
    blocks = rows.select("tensor", "row_id", F.posexplode(F.expr(slices("v", 32))).alias("slice", "b")).withColumn("d", F.expr(N.div(amax("b"), "127")))
    y = f"transform(b, x -> {N.f64(N.mul('x', f'if(d = 0, CAST(0 AS FLOAT), {N.div("1", "nullif(d, 0)")})'))})"
    return blocks.select("tensor", "row_id", "slice", F.expr(f16(N.f64("d"))).alias("scale"), F.expr(f"transform({y}, y -> if(isnan(y), 0, CAST(sign(y) * least(floor(abs(y) + 0.5D), 127D) AS INT)))").alias("codes"))


def q4_0(rows: DataFrame) -> DataFrame:
    """(tensor, row_id, slice, scale, codes): 32 nibbles; the first element of largest magnitude becomes code 0."""
    top = "aggregate(b, CAST(0 AS FLOAT), (m, x) -> if(abs(x) > abs(m), x, m))"
    blocks = rows.select("tensor", "row_id", F.posexplode(F.expr(slices("v", 32))).alias("slice", "b")).withColumn("d", F.expr(N.div(top, "-8")))
    y = N.f32(f"{N.mul('x', f'if(d = 0, CAST(0 AS FLOAT), {N.div("1", "nullif(d, 0)")})')} + CAST(8.5 AS FLOAT)")
    return blocks.select("tensor", "row_id", "slice", F.expr(f16(N.f64("d"))).alias("scale"), F.expr(f"transform(transform(b, x -> {y}), y -> if(isnan(y), 0, CAST(least(15, floor(greatest(y, 0))) AS INT)))").alias("codes"))

def importance(entries: DataFrame) -> DataFrame:
    """(name, w) from (name, sums, counts): each count's block of sums is divided by it; a count of 0 or less makes it 1."""
    width = "CAST(size(sums) div size(counts) AS INT)"
    value = N.div("s", "nullif(counts[CAST(i div k AS INT)], 0)")
    return entries.withColumn("k", F.expr(width)).select("name", F.expr(f"transform(sums, (s, i) -> if(counts[CAST(i div k AS INT)] > 0, {value}, CAST(1 AS FLOAT)))").alias("w"))


def _offset_blocks(rows: DataFrame, levels: int) -> DataFrame:
    """(tensor, row_id, slice, scale, low, codes): 32 elements from their minimum up in ``levels`` steps."""
    blocks = rows.select("tensor", "row_id", F.posexplode(F.expr(slices("v", 32))).alias("slice", "b")).withColumn("low", F.expr("array_min(b)"))
    blocks = blocks.withColumn("d", F.expr(N.div(N.f32(f"{N.f64('array_max(b)')} - {N.f64('low')}"), str(levels))))
    up = N.mul(N.f32(f"{N.f64('x')} - {N.f64('low')}"), f"if(d = 0, CAST(0 AS FLOAT), {N.div('1', 'nullif(d, 0)')})")
    code = f"transform(transform(b, x -> {N.f32(f'{up} + CAST(0.5 AS FLOAT)')}), y -> if(isnan(y), 0, CAST(least({levels}, floor(y)) AS INT)))"
    return blocks.select("tensor", "row_id", "slice", F.expr(f16(N.f64("d"))).alias("scale"), F.expr(f16(N.f64("low"))).alias("low"), F.expr(code).alias("codes"))


def q4_1(rows: DataFrame) -> DataFrame:
    return _offset_blocks(rows, 15)


def q5_1(rows: DataFrame) -> DataFrame:
    return _offset_blocks(rows, 31)


def q5_0(rows: DataFrame) -> DataFrame:
    """(tensor, row_id, slice, scale, codes): 32 elements of 5 bits; the first element of largest magnitude becomes code 0."""
    top = "aggregate(b, CAST(0 AS FLOAT), (m, x) -> if(abs(x) > abs(m), x, m))"
    blocks = rows.select("tensor", "row_id", F.posexplode(F.expr(slices("v", 32))).alias("slice", "b")).withColumn("d", F.expr(N.div(top, "-16")))
    y = N.f32(f"{N.mul('x', f'if(d = 0, CAST(0 AS FLOAT), {N.div("1", "nullif(d, 0)")})')} + CAST(16.5 AS FLOAT)")
    return blocks.select("tensor", "row_id", "slice", F.expr(f16(N.f64("d"))).alias("scale"), F.expr(f"transform(transform(b, x -> {y}), y -> if(isnan(y), 0, CAST(least(31, floor(greatest(y, 0))) AS INT)))").alias("codes"))


def tq2_0(rows: DataFrame) -> DataFrame:
    """(tensor, row_id, slice, scale, codes): 256 elements as 0, 1 or 2 for -1, 0 or 1 times the largest magnitude; halves round away from zero."""
    blocks = rows.select("tensor", "row_id", F.posexplode(F.expr(slices("v", 256))).alias("slice", "b")).withColumn("d", F.expr(amax("b")))
    y = f"transform(b, x -> {N.f64(N.mul('x', f'if(d = 0, CAST(0 AS FLOAT), {N.div("1", "nullif(d, 0)")})'))})"
    return blocks.select("tensor", "row_id", "slice", F.expr(f16(N.f64("d"))).alias("scale"), F.expr(f"transform({y}, y -> if(isnan(y), 1, CAST(sign(y) * floor(abs(y) + 0.5D) AS INT) + 1))").alias("codes"))
