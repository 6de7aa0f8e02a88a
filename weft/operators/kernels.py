"""Kernels that SQL can't express exactly: casts by bits, rotations, bias correction, scale search; Arrow-batched numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.session import ship_package

_F = np.float32


def bf16_bits(x: np.ndarray) -> np.ndarray:
    """Upper halves of floats, rounded to even; NaN stays a quiet NaN."""
    u = np.ascontiguousarray(x, _F).view(np.uint32).astype(np.uint64)
    out = ((u + 0x7FFF + ((u >> 16) & 1)) >> 16).astype(np.uint16)
    return np.where(np.isnan(x), ((u >> 16) | 0x40).astype(np.uint16), out)


def bf16_values(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint32) << 16).view(_F)


def decode(data: bytes, dtype: str) -> np.ndarray:
    """Floats of a payload.  Unsigned 16-bit payloads are bf16 words."""
    match dtype:
        case "F32":
            return np.frombuffer(data, "<f4")
        case "F16":
            return np.frombuffer(data, "<f2").astype(_F)
        case "BF16" | "U16":
            return bf16_values(np.frombuffer(data, "<u2"))
    raise ValueError(f"no float payload: {dtype}")


def cast(data: bytes, dtype: str, target: str) -> bytes:
    """A payload in another float type; equal and non-float types as they are.  Doubles and f16 overflow are refused."""
    if dtype == target or dtype not in ("F64", "F32", "F16", "BF16"):
        return data
    if dtype == "F64":
        raise ValueError("doubles would be rounded twice")
    x = decode(data, dtype)
    if target == "F32":
        return x.astype("<f4").tobytes()
    if target == "BF16":
        return bf16_bits(x).astype("<u2").tobytes()
    if (np.isfinite(x) & (np.abs(x) > 65504)).any():
        raise ValueError("a value is beyond the range of f16")
    return x.astype("<f2").tobytes()


def hadamard(size: int) -> np.ndarray:
    """The normalised Kronecker power of the 4 x 4 matrix with -1 on the anti-diagonal's place; size must be a power of 4."""
    if size < 4 or size & (size - 1) or size.bit_length() % 2 == 0:
        raise ValueError("the group size must be a power of 4, at least 4")
    four = np.array([[1, 1, 1, -1], [1, 1, -1, 1], [1, -1, 1, 1], [-1, 1, 1, 1]], np.float64)
    h = np.ones((1, 1))
    while len(h) < size:
        h = np.kron(h, four)
    return (h / np.sqrt(size)).astype(_F)


def rotate(x: np.ndarray, size: int) -> np.ndarray:
    """Rows rotated group by group; products are summed in doubles, in order, and rounded once."""
    h = hadamard(size).astype(np.float64)
    return (x.astype(np.float64).reshape(len(x), -1, size) @ h).reshape(x.shape).astype(_F)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).astype(_F).reshape(len(v), -1)


def rotated(rows: DataFrame, size: int) -> DataFrame:
    """(tensor, row_id, v) with the rows of each matrix rotated in groups of ``size`` columns; no shuffle."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = rotate(_rows(batch), size)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("tensor"), batch.column("row_id"), v], ["tensor", "row_id", "v"])

    rows = rows.select("tensor", "row_id", "v")
    return rows.mapInArrow(run, rows.schema)


@lru_cache(maxsize=16)
def calibration_mean(width: int, seed: int, samples: int = 3072) -> np.ndarray:
    """Mean input of the calibration draw, drawn once by a worker.  The draw is numpy's normal one, so corrections agree in distribution only."""
    return np.random.default_rng([seed, width]).standard_normal((samples, width)).mean(axis=0)


def bias_correction(rows: DataFrame, decoded: DataFrame, biases: DataFrame, seed: int = 233983427) -> DataFrame:
    """(tensor, row_id, bias): the bias less the mean output error, bias - (w - decoded) . mean input.

    The mean over the samples moves into the product, so a row's correction needs only the row.
    """
    from pyspark.sql import functions as F

    ship_package(rows.sparkSession)
    both = rows.select("tensor", "row_id", "v").join(decoded.select("tensor", "row_id", F.col("v").alias("w")), ["tensor", "row_id"]).join(biases, ["tensor", "row_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch)
                w = batch.column("w").flatten().to_numpy(zero_copy_only=False).astype(_F).reshape(x.shape)
                shift = (x.astype(np.float64) - w) @ calibration_mean(x.shape[1], seed)
                bias = batch.column("bias").to_numpy(zero_copy_only=False) - shift
                yield pa.RecordBatch.from_arrays([batch.column("tensor"), batch.column("row_id"), pa.array(bias.astype(_F))], ["tensor", "row_id", "bias"])

    return both.mapInArrow(run, f"tensor {rows.schema['tensor'].dataType.simpleString()}, row_id long, bias float")


GRID = np.array([0, 0.5, 1, 1.5, 2, 3, 4, 6])
_E4M3 = np.array([np.nan if b == 127 else (b % 8) * 2.0**-9 if b < 8 else (1 + (b % 8) / 8) * 2.0 ** (b // 8 - 7) for b in range(128)])


def nearest(x: np.ndarray) -> np.ndarray:
    """Values on the grid of the 4-bit float; ties to the even place."""
    edges = (GRID[1:] + GRID[:-1]) / 2
    k = np.searchsorted(edges, np.abs(x))
    tie = (k < 7) & (np.abs(x) == edges[np.minimum(k, 6)]) & (k % 2 == 1)
    return np.sign(x) * GRID[k + tie]


def search_scales(x: np.ndarray, tensor_scale: float, reach: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Scale bytes of 16-element blocks (n, 16) that lose least within ``reach`` of the usual byte, and their squared errors."""
    usual = np.abs(x).max(axis=1) / 6 / tensor_scale
    anchor = np.abs(_E4M3[None, :127] - np.minimum(usual, 448)[:, None]).argmin(axis=1)
    best, error = anchor.copy(), np.full(len(x), np.inf)
    for step in range(-reach, reach + 1):
        byte = np.clip(anchor + step, 0, 126)
        total = _E4M3[byte] * tensor_scale
        q = np.where(total[:, None] > 0, nearest(np.clip(x / np.where(total > 0, total, 1)[:, None], -6, 6)) * total[:, None], 0)
        e = ((x - q) ** 2).sum(axis=1)
        better = e < error
        best, error = np.where(better, byte, best), np.where(better, e, error)
    return best, error


ROUNDS, CLAMP = 3, 4.0
_SCALES = np.nan_to_num(_E4M3).astype(_F)  # byte 127 stands for blocks of zeros


def _encoded(enc: np.ndarray, raw: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-bit values of blocks at their whole scales, and squared errors against the values before rounding to bf16."""
    with np.errstate(all="ignore"):
        d = np.clip(enc / np.where(total == 0, _F(1), total)[:, None], _F(-6), _F(6))
        q = np.where(total[:, None] == 0, 0, nearest(d)).astype(_F)
        e = raw.astype(np.float64) - (q * total[:, None]).astype(np.float64)
        return q, np.cumsum(e * e, axis=1)[:, -1]  # summed in order


def search_states(x: np.ndarray, scales: list[float]) -> tuple[list[np.ndarray], list[np.ndarray], tuple[float, float]]:
    """States of the blocks (n, 16) of a tensor whose scale took the values ``scales`` in turn, and the sums of the next refit.

    Returns scale bytes and squared errors by block: of the usual bytes; then, for each scale, of the best bytes within 4 of
    the usual one, and of these at the next scale.  A byte must lose strictly less than the one before to replace it.
    """
    raw = np.ascontiguousarray(x, _F)
    enc, first = bf16_values(bf16_bits(raw)), _F(scales[0])
    with np.errstate(all="ignore"):
        usual = np.minimum(np.abs(enc).max(axis=1) / _F(6) / first, _F(448))
    edges = (_E4M3[1:127] + _E4M3[:126]) / 2
    k = np.searchsorted(edges, usual)
    byte = np.where(np.isnan(usual), 127, k + ((k < 126) & (usual == edges[np.minimum(k, 125)]) & (k % 2 == 1)))
    total = first * _SCALES[byte]
    q, e = _encoded(enc, raw, total)
    frozen = (total == 0) | ~np.isfinite(total)
    low, high = np.maximum(byte - 4, 0), np.minimum(byte + 4, 126)
    bytes_, errors, cross, norm = [byte], [e], 0.0, 0.0
    for at, scale in enumerate(map(_F, scales)):
        best = byte.copy()
        q, e = _encoded(enc, raw, scale * _SCALES[best])
        for step in range(9):
            other = low + step
            q2, e2 = _encoded(enc, raw, scale * _SCALES[np.minimum(other, 126)])
            better = (e2 < e) & ~frozen & (other <= high)
            best, e, q = np.where(better, other, best), np.where(better, e2, e), np.where(better[:, None], q2, q)
        bytes_.append(best)
        errors.append(e)
        c = q.astype(np.float64) * np.where(frozen, 0, _SCALES[best]).astype(np.float64)[:, None]
        cross, norm = float((c * raw).sum()), float((c * c).sum())
        if at + 1 < len(scales):
            bytes_.append(best)
            errors.append(_encoded(enc, raw, _F(scales[at + 1]) * _SCALES[best])[1])
        byte = best
    return bytes_, errors, (cross, norm)


def _blocks(row: np.ndarray) -> np.ndarray:
    return np.pad(row, (0, -len(row) % 16)).reshape(-1, 16)


def scale_search(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """(tensor, row_id, bytes, error, tensor_scale): scale bytes and the tensor's scale by least squared error.

    ``scales`` has the usual tensor_scale.  Three rounds choose the bytes within 4 of the usual ones, refit the tensor's scale
    in closed form, within a quarter and four times the usual one, and encode again; the state of the whole tensor that loses
    least is kept, the usual one included.  Every round is a pass over the rows that repeats the rounds before, so
    only a tensor's few scales and sums travel.
    """
    from pyspark.sql import functions as F

    ship_package(rows.sparkSession)
    rows = rows.select("tensor", "row_id", "v")
    name = f"tensor {rows.schema['tensor'].dataType.simpleString()}"

    def each(row_of, schema: str, given: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = []
                for v, s, best in zip(batch.column("v"), batch.column("scales").to_pylist(), batch.column("best").to_pylist(), strict=True):
                    got.append(row_of(search_states(_blocks(np.array(v.values.to_numpy(zero_copy_only=False), _F)), s), best))
                if got:
                    columns = [pa.array(c, pa.list_(pa.int32())) if isinstance(c[0], list) else pa.array(c, pa.float64()) for c in zip(*got, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("tensor"), batch.column("row_id"), *columns], ["tensor", "row_id", *[f.split()[0] for f in schema.split(", ")]])

        return rows.join(given, "tensor").mapInArrow(run, f"{name}, row_id long, {schema}")

    state = scales.select("tensor", F.array(F.col("tensor_scale").cast("float").cast("double")).alias("scales"), F.lit(0).alias("best"))
    for _ in range(ROUNDS):
        sums = each(lambda found, best: found[2], "cross double, norm double", state).groupBy("tensor").agg(F.sum("cross").alias("cross"), F.sum("norm").alias("norm"))
        refit = F.expr("CASE WHEN norm > 0 AND cross > 0 AND norm < DOUBLE('Infinity') AND cross < DOUBLE('Infinity') THEN CAST(CAST(cross / norm AS FLOAT) AS DOUBLE) END")
        refit = F.when(refit > 0, F.least(F.greatest(refit, F.col("scales")[0] / CLAMP), F.col("scales")[0] * CLAMP)).otherwise(F.element_at("scales", -1))
        state = state.join(sums, "tensor").select("tensor", F.concat("scales", F.array(refit)).alias("scales"), "best")
    n = 2 * ROUNDS + 1
    losses = each(lambda found, best: tuple(float(e.sum()) for e in found[1][:n]), ", ".join(f"e{k} double" for k in range(n)), state)
    losses = losses.groupBy("tensor").agg(F.array(*[F.sum(f"e{k}") for k in range(n)]).alias("e"))
    best = "if(e[0] < DOUBLE('Infinity'), aggregate(sequence(1, size(e) - 1), 0, (b, k) -> if(e[k] < e[b], k, b)), 0)"  # not a number: greater
    state = state.drop("best").join(losses.select("tensor", F.expr(best).alias("best")), "tensor")
    out = each(lambda found, best: (found[0][best].tolist(), float(found[1][best].sum())), "bytes array<int>, error double", state.select("tensor", "scales", "best"))
    return out.join(state.select("tensor", F.expr("scales[best div 2]").alias("tensor_scale")), "tensor")


# The 16 levels of the non-linear 4-bit format.
LEVELS = np.array([-127, -104, -83, -65, -49, -35, -22, -10, 1, 13, 25, 38, 53, 69, 89, 113], np.float64)


def iq4_nl(x: np.ndarray, weights: np.ndarray | None = None, tries: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(scale, level numbers) of 32-element blocks (n, 32): the scale of 2 * tries + 1 that loses least by weighted squares."""
    w = np.ones_like(x) if weights is None else weights * np.sqrt((2 * (x * x).mean(axis=1, keepdims=True)) + x * x)
    at = np.abs(x).argmax(axis=1)
    top = x[np.arange(len(x)), at]
    edges = (LEVELS[1:] + LEVELS[:-1]) / 2
    best, scale, codes = np.full(len(x), -np.inf), np.zeros(len(x)), np.zeros(x.shape, np.int64)
    for t in range(-tries, tries + 1):
        inverse = np.where(top != 0, (t + LEVELS[0]) / np.where(top != 0, top, 1), 0)
        k = np.searchsorted(edges, x * inverse[:, None], "right")
        q = LEVELS[k]
        cross, norm = (w * q * x).sum(axis=1), (w * q * q).sum(axis=1)
        gain = np.where(norm > 0, cross * cross / np.where(norm > 0, norm, 1), 0)
        better = gain > best
        best, scale = np.where(better, gain, best), np.where(better, np.where(norm > 0, cross / np.where(norm > 0, norm, 1), 0), scale)
        codes = np.where(better[:, None], k, codes)
    return scale, codes
