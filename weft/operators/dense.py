"""Numpy kernels of the block formats, and how rows (tensor, row_id, v) go through them in Arrow batches.

A kernel takes the rows of one width as a matrix of 32-bit floats, and facts of these rows by name; it returns one array for
each result column.  Products and quotients are of 32-bit floats, rounded once.  The work is linear in the elements,
and at most ``ELEMENTS`` (or one row) are encoded at a time, whatever the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.kernels import bf16_bits, bf16_values
from weft.session import ship_package

_F = np.float32
TINY = _F(1e-12)
ELEMENTS = 1 << 20
#: Rows of a group of whole tile rows, unless one tile row has more.
ROWS = 512
#: Tensors whose facts are broadcast; a longer list is joined as Spark sees fit.
TENSORS = 200_000

Kernel = Callable[[np.ndarray, dict[str, np.ndarray]], list[np.ndarray]]
_ARROW = {"double": pa.float64(), "float": pa.float32(), "int": pa.int32(), "boolean": pa.bool_()}
_ARROW |= {f"array<{name}>": pa.list_(kind) for name, kind in _ARROW.items()}


def _column(values: np.ndarray | None, kind: pa.DataType, n: int) -> pa.Array:
    if values is None:
        return pa.nulls(n, kind)
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends = np.arange(n + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).reshape(-1)).cast(kind.value_type, safe=False))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Runs of rows of one width; -1 where v is null."""
    width = pc.fill_null(pc.list_value_length(batch.column("v")), -1).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(np.diff(width)) + 1).tolist(), len(width)]
    for first, end in zip(edges[:-1], edges[1:], strict=True):
        if first < end:
            step = max(1, ELEMENTS // max(int(width[first]), 1))
            for at in range(first, end, step):
                yield batch.slice(at, min(step, end - at)), int(width[first])


def _encoded(batch: pa.RecordBatch, kernel: Kernel, columns: dict[str, str]) -> Iterator[pa.RecordBatch]:
    for part, width in _pieces(batch):
        n = part.num_rows
        if width < 0:
            found = [None] * len(columns)
        else:
            x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(_F, copy=False).reshape(n, width)
            facts = {name: part.column(name).to_numpy(zero_copy_only=False) for name in part.schema.names if name not in ("tensor", "row_id", "v")}
            with np.errstate(all="ignore"):
                found = kernel(x, facts)
        arrays = [_column(a, _ARROW[kind], n) for a, kind in zip(found, columns.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("tensor"), part.column("row_id"), *arrays], ["tensor", "row_id", *columns])


def _schema(rows: DataFrame, columns: dict[str, str]) -> str:
    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ("tensor", "row_id"))
    return ", ".join([keys, *(f"{name} {kind}" for name, kind in columns.items())])


def encode(rows: DataFrame, kernel: Kernel, columns: dict[str, str]) -> DataFrame:
    """(tensor, row_id, columns) of every row; a null v gives nulls.  No shuffle."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _encoded(batch, kernel, columns)

    return rows.mapInArrow(run, _schema(rows, columns))


def encode_tiles(rows: DataFrame, size: int, kernel: Kernel, columns: dict[str, str]) -> DataFrame:
    """The same with a fact more: ``tile_max``, by row the largest magnitudes of the size x size tiles that it goes through.

    One shuffle brings tile rows together, whole and at most ``ROWS`` rows (or one tile row) in a group; it needs no other.
    """
    ship_package(rows.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        places = group.column("row_id").to_numpy()
        tiles, tile = np.unique(places // size, return_inverse=True)
        batch = group.drop_columns(["band"]).append_column("tile", pa.array(tile)).combine_chunks().to_batches()[0]
        pieces = [(part, width) for part, width in _pieces(batch) if width > 0]
        top = np.zeros((len(tiles), -(-max((w for _, w in pieces), default=0) // size)), _F)
        for part, width in pieces:
            x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(_F, copy=False).reshape(part.num_rows, width)
            own = slice_max(np.where(np.isnan(x), 0, np.abs(x)), size)
            np.maximum.at(top[:, : own.shape[1]], part.column("tile").to_numpy(), own)
        done = _encoded(batch, lambda x, facts: kernel(x, facts | {"tile_max": top[facts["tile"], : -(-x.shape[1] // size)]}), columns)
        return pa.Table.from_batches(list(done))

    banded = rows.withColumn("band", F.expr(f"row_id div {size * max(1, ROWS // size)}"))
    return banded.groupBy("tensor", "band").applyInArrow(run, _schema(rows, columns))


def magnitudes(x: np.ndarray, facts: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Facts of rows: largest magnitude without NaN, whether there is a NaN, whether all is zero, width."""
    a = np.abs(x)
    nan = np.isnan(a)
    top = np.where(nan, 0, a).max(axis=1, initial=0) if x.shape[1] else np.zeros(len(x), _F)
    return [top, nan.any(axis=1), (a == 0).all(axis=1), np.full(len(x), x.shape[1], np.int32)]


def with_facts(rows: DataFrame, size: int | None = None) -> DataFrame:
    """Adds the tensor's ``amax`` (without NaN), ``nan`` and ``zeros``; with ``size`` also ``whole``: its rows and columns divide into tiles of that size.

    The facts are one row for each tensor, broadcast while there are at most ``TENSORS``, which a scan of that column finds.
    """
    rows = rows.select("tensor", "row_id", "v")
    each = encode(rows, magnitudes, {"top": "float", "nan": "boolean", "zero": "boolean", "width": "int"})
    facts = [F.coalesce(F.max("top"), F.lit(0.0).cast("float")).alias("amax"), F.coalesce(F.bool_or("nan"), F.lit(False)).alias("nan"), F.coalesce(F.bool_and("zero"), F.lit(False)).alias("zeros")]
    if size:
        divides = F.expr(f"count(*) % {size} = 0 AND max(row_id) = count(*) - 1 AND bool_and(coalesce(width, 0) % {size} = 0)")
        facts.append(F.coalesce(divides, F.lit(False)).alias("whole"))
    facts = each.groupBy("tensor").agg(*facts)
    few = rows.select("tensor").distinct().limit(TENSORS + 1).count() <= TENSORS
    return rows.join(F.broadcast(facts) if few else facts, "tensor")


def slice_max(a: np.ndarray, size: int) -> np.ndarray:
    """Maxima of a matrix's slices of ``size`` columns (the last may be shorter); NaN wins."""
    rest = -a.shape[1] % size
    return np.pad(a, ((0, 0), (0, rest))).reshape(len(a), -1, size).max(axis=2) if a.shape[1] else np.zeros((len(a), 0), a.dtype)


def row_max(x: np.ndarray) -> np.ndarray:
    return magnitudes(x, {})[0]


def clipped(top: np.ndarray, clip: float | None) -> np.ndarray:
    return top * _F(clip) if clip else top


def _inverse(q: np.ndarray) -> np.ndarray:
    return _F(1) / q


def int8_codes(y: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(y), 0, np.clip(np.rint(y), -127, 127)).astype(np.int32)


def e4m3(y: np.ndarray) -> np.ndarray:
    """Values nearest to floats with 4 exponent and 3 mantissa bits, ties to even, at most 448 in size; NaN stays NaN."""
    y = y.astype(np.float64)
    a = np.abs(y)
    _, e = np.frexp(np.where(np.isfinite(a), a, 1))
    step = np.ldexp(1.0, np.clip(e - 1, -6, 8) - 3)
    return np.where(a >= 464, np.sign(y) * 448, np.rint(y / step) * step)


def e4m3_codes(v: np.ndarray) -> np.ndarray:
    """Bytes of values on that grid (plus zero for zero, 127 for NaN)."""
    a = np.where(np.isnan(v), 0, np.abs(v))
    _, e = np.frexp(a)
    e = np.clip(e - 1, -6, 8)
    body = np.where(a < 2.0**-6, a * 512, (e + 6) * 8 + np.ldexp(a, 3 - e))
    return np.where(np.isnan(v), 127, body + np.where(v < 0, 128, 0)).astype(np.int32)


def e2m1_codes(y: np.ndarray) -> np.ndarray:
    """Nibbles of floats on the grid 0, .5, 1, 1.5, 2, 3, 4, 6; ties to the even code, 4 for NaN."""
    a = np.abs(y)
    code = np.zeros(y.shape, np.int32)
    for k, edge in enumerate((0.25, 0.75, 1.25, 1.75, 2.5, 3.5, 5)):
        code += a >= edge if k % 2 else a > edge
    return np.where(np.isnan(y), 4, code + np.where(y < 0, 8, 0))


def _one(scale: np.ndarray) -> np.ndarray:
    return scale.astype(np.float64)[:, None]


def int8_tensor(clip: float | None) -> Kernel:
    def kernel(x: np.ndarray, facts: dict[str, np.ndarray]) -> list[np.ndarray]:
        top = np.maximum(clipped(facts["amax"].astype(_F), clip), TINY)
        s = np.where(facts["zeros"], _F(1), top / _F(127))
        return [_one(s), int8_codes(x * _inverse(s)[:, None])]

    return kernel


def int8_row(clip: float | None) -> Kernel:
    def kernel(x: np.ndarray, facts: dict[str, np.ndarray]) -> list[np.ndarray]:
        q = _F(127) * _inverse(np.maximum(clipped(row_max(x), clip), TINY))
        return [_one(np.where(facts["zeros"], _F(1), _inverse(q))), int8_codes(x * q[:, None])]

    return kernel


def _wide(per_tile: np.ndarray, size: int, width: int) -> np.ndarray:
    return np.repeat(per_tile, size, axis=-1)[..., :width]


def int8_block(size: int, clip: float | None) -> Kernel:
    def kernel(x: np.ndarray, facts: dict[str, np.ndarray]) -> list[np.ndarray]:
        s = np.maximum(clipped(facts["tile_max"], clip) / _F(127), _F(1e-8))
        s = np.where(facts["zeros"][:, None], _F(1), s)
        return [s.astype(np.float64), int8_codes(x / _wide(s, size, x.shape[1]))]

    return kernel


def _fp8(x: np.ndarray, q: np.ndarray, scales: np.ndarray) -> list[np.ndarray]:
    values = e4m3(x * q)
    return [scales, e4m3_codes(values), values]


def _fp8_scale(top: np.ndarray) -> np.ndarray:
    return _F(448) * _inverse(np.maximum(top, TINY))


def fp8_tensor(x: np.ndarray, facts: dict[str, np.ndarray]) -> list[np.ndarray]:
    q = _fp8_scale(facts["amax"].astype(_F))
    return _fp8(x, q[:, None], np.where(facts["zeros"][:, None], 1, _one(_inverse(q))))


def fp8_row(x: np.ndarray, facts: dict[str, np.ndarray]) -> list[np.ndarray]:
    return fp8_tensor(x, facts | {"amax": row_max(x)})


def fp8_block(size: int) -> Kernel:
    def kernel(x: np.ndarray, facts: dict[str, np.ndarray]) -> list[np.ndarray]:
        if "whole" in facts and not facts["whole"].all():  # one tensor's rows: all or none
            return fp8_row(x, facts)
        q = _fp8_scale(facts["tile_max"])
        return _fp8(x, _wide(q, size, x.shape[1]), np.where(facts["zeros"][:, None], 1, _inverse(q).astype(np.float64)))

    return kernel


def _rounded(x: np.ndarray, size: int) -> np.ndarray:
    """bf16 values in slices (rows, slices, size), filled up with zeros."""
    x = bf16_values(bf16_bits(x)).reshape(x.shape)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % size))).reshape(len(x), -(-x.shape[1] // size), size)


def mxfp8(compensate: float) -> Kernel:
    def kernel(x: np.ndarray, facts: dict[str, np.ndarray]) -> list[np.ndarray]:
        b = _rounded(x, 32)
        top = np.where(np.isnan(b), 0, np.abs(b)).max(axis=2, initial=0).astype(_F)
        need = np.maximum(((top / _F(448)).astype(np.float64) * compensate).astype(_F), _F(2.0**-127)).astype(np.float64)
        power = np.where(np.isinf(need), 127, np.ceil(np.log2(need).astype(_F)))
        exps = np.clip(power + 127, 0, 254)
        y = (b.astype(np.float64) / np.exp2(exps - 127)[:, :, None]).astype(_F)
        values = np.where((top == 0)[:, :, None] & ~np.isnan(b), 0, e4m3(y)).reshape(len(x), -1)
        return [exps, e4m3_codes(values), values, np.full(len(x), x.shape[1], np.int32)]

    return kernel


def nvfp4(x: np.ndarray, facts: dict[str, np.ndarray]) -> list[np.ndarray]:
    pts = np.where(facts["nan"], _F(np.nan), facts["amax"].astype(_F)) / _F(2688)
    b = _rounded(x, 16)
    top = np.abs(b).max(axis=2, initial=0)
    tops = e4m3(np.where((pts == 0)[:, None], _F(np.nan), top / _F(6) / pts[:, None]))
    totals = (pts.astype(np.float64)[:, None] * tops).astype(_F)
    codes = np.where((totals == 0)[:, :, None], 0, e2m1_codes(b / totals[:, :, None])).reshape(len(x), -1)
    return [e4m3_codes(tops).astype(np.float64), codes, pts.astype(np.float64), totals, np.full(len(x), x.shape[1], np.int32)]
