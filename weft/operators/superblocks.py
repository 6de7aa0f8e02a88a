"""Super-blocks of 256 elements in 2 to 6 bits: searches by weighted least squares over all groups of a batch at once.

A super-block holds groups of 16 or 32 elements.  A group's scale (and minimum) comes from a search; the super-block
stores them as small whole numbers of one (two) half-precision scale, and the elements are coded anew by what was stored.
Steps are taken in 32 bits, sums in order, so that results agree with element-by-element encoders to the bit.
Weights, one for each column of a tensor, say how much an element's error counts; without them its size does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import ship_package

_F = np.float32
SIZE = 256
#: A group whose largest element or scale is smaller is all zeros.
TINY = _F(1e-15)


def _sum(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, axis=-1, dtype=_F)[..., -1]


def _col(x: np.ndarray) -> np.ndarray:
    return x[..., None]


def search_affine(x: np.ndarray, w: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scale, -minimum, codes 0 to top) of groups (n, k): of the plain range and 37 stretched ones, the refit that loses least."""
    low, high = np.minimum(x.min(axis=-1), _F(0)), x.max(axis=-1)
    flat = high <= low

    def codes(stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inverse = stretch / np.where(flat, _F(1), high - low)
        return inverse, np.clip(np.rint(_col(inverse) * (x - _col(low))), 0, top).astype(_F)

    sum_w, sum_x = _sum(w), _sum(w * x)
    inverse, best = codes(_F(top))
    scale = _F(1) / inverse
    least = _sum(w * (_col(scale) * best + _col(low) - x) ** 2)
    for step in range(37):
        _, q = codes(_F(-0.9) + _F(0.05) * _F(step) + _F(top))
        sum_q, sum_qq, sum_xq = _sum(w * q), _sum((w * q) * q), _sum((w * q) * x)
        det = sum_w * sum_qq - sum_q * sum_q
        good = det > 0
        det = np.where(good, det, _F(1))
        s, m = (sum_w * sum_xq - sum_x * sum_q) / det, (sum_qq * sum_x - sum_q * sum_xq) / det
        s, m = np.where(m > 0, sum_xq / np.where(sum_qq == 0, _F(1), sum_qq), s), np.minimum(m, _F(0))
        loss = _sum(w * (_col(s) * q + _col(m) - x) ** 2)
        good &= (loss < least) & ~flat
        scale, low, least, best = np.where(good, s, scale), np.where(good, m, low), np.where(good, loss, least), np.where(_col(good), q, best)
    return np.where(flat, _F(0), scale), -low, np.where(_col(flat), 0, best).astype(np.int64)


def search_positive(x: np.ndarray, w: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(scale, codes 0 to top) of groups without negative numbers: the best of nine scales, then codes changed one by one while that helps."""
    most = np.maximum(x.max(axis=-1), _F(0))
    none = most < TINY
    most = np.where(none, _F(1), most)
    best = _F(top) / most
    least = _sum(w * (x - _col(_F(1) / best) * np.rint(_col(best) * x)) ** 2)
    for step in (-4, -3, -2, -1, 1, 2, 3, 4):
        inverse = (_F(0.1) * _F(step) + _F(top)) / most
        loss = _sum(w * (x - _col(_F(1) / inverse) * np.minimum(np.rint(_col(inverse) * x), top)) ** 2)
        best, least = np.where(loss < least, inverse, best), np.where(loss < least, loss, least)
    q = np.minimum(np.rint(_col(best) * x), top).astype(_F)
    cross, norm = _sum((w * x) * q), _sum((w * q) * q)
    for _ in range(5):
        for i in range(x.shape[-1]):
            wi, xi, qi = w[..., i], x[..., i], q[..., i]
            c, n = cross - (wi * xi) * qi, norm - (wi * qi) * qi
            can = (c > 0) & (n > 0)
            new = np.where(can, np.minimum(np.rint(np.divide(xi * n, c, out=np.zeros_like(xi), where=can)), top), qi)
            c, n = c + (wi * xi) * new, n + (wi * new) * new
            better = can & (new != qi) & (c * c * norm > cross * cross * n)
            q[..., i] = np.where(better, new, qi)
            cross, norm = np.where(better, c, cross), np.where(better, n, norm)
    scale = np.where(norm > 0, cross / np.where(norm > 0, norm, _F(1)), _F(0))
    return np.where(none, _F(0), scale), np.where(_col(none), 0, q).astype(np.int64)


def search_symmetric(x: np.ndarray, w: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(scale, codes 0 to 2 * top - 1, ``top`` standing for 0): the largest element may have either sign; the best of 19 scales."""
    at = np.abs(x).argmax(axis=-1)
    most = np.take_along_axis(x, _col(at), -1)[..., 0]
    none = np.abs(most) < TINY
    most = np.where(none, _F(1), most)

    def fit(stretch: _F) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = np.clip(np.rint(_col(-stretch / most) * x), -top, top - 1).astype(_F)
        return q, _sum((w * x) * q), _sum((w * q) * q)

    best, cross, norm = fit(_F(top))
    scale = np.where(norm != 0, cross / np.where(norm != 0, norm, _F(1)), _F(0))
    gain = scale * cross
    for step in range(-9, 10):
        if step:
            q, cross, norm = fit(_F(top) + _F(0.1) * _F(step))
            better = (norm > 0) & (cross * cross > gain * norm)
            s = cross / np.where(better, norm, _F(1))
            scale, gain, best = np.where(better, s, scale), np.where(better, s * cross, gain), np.where(_col(better), q, best)
    return np.where(none, _F(0), scale), np.where(_col(none), 0, best + top).astype(np.int64)


def _half(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float16)


def _bytes(half: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(half).view(np.uint8).reshape(len(half), 2)


def _spread(parts: list[np.ndarray], bits: int) -> np.ndarray:
    """Bytes that hold the parts' numbers side by side, the first lowest."""
    return sum(p << (bits * k) for k, p in enumerate(parts))


@dataclass(frozen=True)
class Kind:
    """``group`` elements share a scale of ``scale_bits``; with ``affine`` also a minimum."""

    bits: int
    group: int
    affine: bool
    scale_bits: int


# The five layouts of the public format.
KINDS = {"q2_k": Kind(2, 16, True, 4), "q3_k": Kind(3, 16, False, 6), "q4_k": Kind(4, 32, True, 6), "q5_k": Kind(5, 32, True, 6), "q6_k": Kind(6, 16, False, 8)}


def _weights(kind: str, x: np.ndarray, given: np.ndarray | None) -> np.ndarray:
    """Weights of elements (n, groups, k)."""
    squares = _sum((x * x).reshape(len(x), SIZE))
    mean = ((squares if kind == "q2_k" else _F(2) * squares) / _F(SIZE))[:, None, None]
    if given is not None:
        return given if kind == "q6_k" else given * np.sqrt(mean + x * x)
    return {"q2_k": lambda: np.abs(x), "q3_k": lambda: x * x, "q4_k": lambda: np.sqrt(mean) + np.abs(x), "q5_k": lambda: np.sqrt(mean) + np.abs(x), "q6_k": lambda: x * x}[kind]()


def encode(kind: str, values: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Bytes (n, size) of super-blocks (n, 256); ``weights`` has their shape."""
    k = KINDS[kind]
    x = np.ascontiguousarray(values, _F).reshape(len(values), -1, k.group)
    w = _weights(kind, x, None if weights is None else np.ascontiguousarray(weights, _F).reshape(x.shape))
    top = 1 << k.bits
    if k.affine:
        scale, low, q = search_affine(x, w, top - 1)
        total = _sum(np.tile(w, 16)) if kind == "q2_k" else _sum(w)  # there every group's sum is taken 16 times over
        most = (1 << k.scale_bits) - 1
        (d, ls), (m, lm) = search_positive(scale, total, most), search_positive(low, total, most)
        d, m = _half(d), _half(m)
        step, shift = d.astype(_F)[:, None] * ls.astype(_F), m.astype(_F)[:, None] * lm.astype(_F)
        own = np.clip(np.rint((x + _col(shift)) / _col(np.where(step == 0, _F(1), step))), 0, top - 1).astype(np.int64)
    else:
        scale, q = search_symmetric(x, w, top // 2)
        if kind == "q3_k":
            d, ls = search_symmetric(scale, _sum(w), 32)
            d, stored = _half(d), ls - 32
        else:
            first = np.abs(scale).argmax(axis=1)
            most = scale[np.arange(len(scale)), first]
            none = np.abs(most) < TINY
            inverse = _F(-128) / np.where(none, _F(1), most)
            d = _half(np.where(none, _F(0), _F(1) / inverse))
            stored = np.where(none[:, None], 0, np.minimum(np.rint(inverse[:, None] * scale), 127)).astype(np.int64)
            q = np.where(none[:, None, None], 0, q)
        step = d.astype(_F)[:, None] * stored.astype(_F)
        own = (np.clip(np.rint(x / _col(np.where(step == 0, _F(1), step))), -top // 2, top // 2 - 1) + top // 2).astype(np.int64)
    q = np.where(_col(step == 0), q, own).reshape(len(x), SIZE)
    halves = [q.reshape(len(q), 2, 4, 32)[:, :, i] for i in range(4)]  # quarters of each 128
    pairs = [q.reshape(len(q), 4, 2, 32)[:, :, i] for i in range(2)]  # halves of each 64

    def flat(a: np.ndarray) -> np.ndarray:
        return a.reshape(len(q), -1).astype(np.uint8)

    match kind:
        case "q2_k":
            parts = [flat(ls | lm << 4), flat(_spread(halves, 2)), _bytes(d), _bytes(m)]
        case "q3_k":
            high = _spread([q.reshape(len(q), 8, 32)[:, i] >> 2 for i in range(8)], 1)
            low4 = _spread([ls[:, :8] & 15, ls[:, 8:] & 15], 4)
            high2 = _spread([ls.reshape(len(q), 4, 4)[:, i] >> 4 for i in range(4)], 2)
            parts = [flat(high), flat(_spread([p & 3 for p in halves], 2)), flat(low4), flat(high2), _bytes(d)]
        case "q4_k" | "q5_k":
            small = [ls[:, :4] | ls[:, 4:] >> 4 << 6, lm[:, :4] | lm[:, 4:] >> 4 << 6, ls[:, 4:] & 15 | (lm[:, 4:] & 15) << 4]
            parts = [_bytes(d), _bytes(m), *map(flat, small)]
            if kind == "q5_k":
                parts.append(flat(_spread([q.reshape(len(q), 8, 32)[:, i] >> 4 for i in range(8)], 1)))
            parts.append(flat(_spread([p & 15 for p in pairs], 4)))
        case _:
            low4 = np.stack([halves[0] & 15 | (halves[2] & 15) << 4, halves[1] & 15 | (halves[3] & 15) << 4], axis=2)
            parts = [flat(low4), flat(_spread([p >> 4 for p in halves], 2)), flat(stored & 255), _bytes(d)]
    return np.concatenate(parts, axis=1)


def decode(kind: str, data: np.ndarray) -> np.ndarray:
    """Values (n, 256) of super-blocks' bytes."""
    k, n = KINDS[kind], len(data)
    b = data.astype(np.int64)

    def half(at: int) -> np.ndarray:
        return np.ascontiguousarray(data[:, at : at + 2]).view(np.float16).astype(_F)

    def quarters(a: np.ndarray) -> np.ndarray:
        return np.stack([a.reshape(n, 2, 32) >> (2 * i) & 3 for i in range(4)], axis=2).reshape(n, SIZE)

    if kind == "q2_k":
        d, m, ls, lm, q = half(80), half(82), b[:, :16] & 15, b[:, :16] >> 4, quarters(b[:, 16:80])
    elif kind in ("q4_k", "q5_k"):
        d, m, s = half(0), half(2), b[:, 4:16]
        ls = np.concatenate([s[:, :4] & 63, s[:, 8:] & 15 | s[:, :4] >> 6 << 4], axis=1)
        lm = np.concatenate([s[:, 4:8] & 63, s[:, 8:] >> 4 | s[:, 4:8] >> 6 << 4], axis=1)
        low = b[:, -128:].reshape(n, 4, 32)
        q = np.stack([low & 15, low >> 4], axis=2).reshape(n, SIZE)
        if kind == "q5_k":
            q |= np.stack([b[:, 16:48] >> i & 1 for i in range(8)], axis=1).reshape(n, SIZE) << 4
    elif kind == "q3_k":
        s = b[:, 96:108]
        ls = np.concatenate([s[:, :8] & 15, s[:, :8] >> 4], axis=1) | np.concatenate([s[:, 8:] >> (2 * i) & 3 for i in range(4)], axis=1) << 4
        d, ls = half(108), ls - 32
        q = quarters(b[:, 32:96]) + (np.stack([b[:, :32] >> i & 1 for i in range(8)], axis=1).reshape(n, SIZE) << 2) - 4
    else:
        low = b[:, :128].reshape(n, 2, 2, 32)
        q = np.stack([low[:, :, 0] & 15, low[:, :, 1] & 15, low[:, :, 0] >> 4, low[:, :, 1] >> 4], axis=2).reshape(n, SIZE)
        q = (q | quarters(b[:, 128:192]) << 4) - 32
        d, ls = half(208), data[:, 192:208].astype(np.int8).astype(np.int64)
    out = (d * ls.astype(_F))[:, :, None] * q.reshape(n, -1, k.group).astype(_F)
    return (out - (m * lm.astype(_F))[:, :, None] if k.affine else out).reshape(n, SIZE)


def superblocks(rows: DataFrame, kind: str, weights: DataFrame | None = None, fill: bool = False) -> DataFrame:
    """(tensor, row_id, data): each row's super-blocks, bytes one after the other; row lengths must be multiples of 256.

    With ``fill`` they needn't be: a row's last super-block is filled up with zeros, which count nothing where there are weights.
    ``weights`` (tensor, w) holds a weight for each column of a tensor; tensors without any are encoded by their own sizes.
    A row and its weights are all that is needed, so nothing is shuffled but the join, which Spark broadcasts if it is small.
    """
    ship_package(rows.sparkSession)
    rows = rows.select("tensor", "row_id", "v")
    rows = rows.join(weights.select("tensor", "w"), "tensor", "left") if weights is not None else rows.withColumn("w", F.lit(None).cast("array<float>"))

    def cut(values: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` numbers, then zeros, in super-blocks."""
        return np.pad(values[:n], (0, -(-n // SIZE) * SIZE - len(values[:n]))).reshape(-1, SIZE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, w in zip(batch.column("v"), batch.column("w"), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(_F)
                if len(x) % SIZE and not fill:
                    raise ValueError(f"a row of {len(x)} elements isn't whole super-blocks of {SIZE}")
                own = w.values.to_numpy(zero_copy_only=False).astype(_F) if w.is_valid else None
                if own is not None:
                    own = cut(own, len(x)) if fill else own.reshape(-1, SIZE)
                out.append(encode(kind, cut(x, len(x)), own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("tensor"), batch.column("row_id"), pa.array(out, pa.binary())], ["tensor", "row_id", "data"])

    return rows.mapInArrow(run, f"tensor {rows.schema['tensor'].dataType.simpleString()}, row_id long, data binary")
