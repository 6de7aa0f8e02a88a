"""GGUF containers (version 3, public format): metadata and tensors with block types; importance weights in either layout."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weft.plans.methods import BLOCKS

# Type numbers of the format.
TYPES = {
    "F32": 0, "F16": 1, "Q4_0": 2, "Q4_1": 3, "Q5_0": 6, "Q5_1": 7, "Q8_0": 8, "Q2K": 10, "Q3K": 11, "Q4K": 12, "Q5K": 13, "Q6K": 14, "Q8K": 15,
    "IQ2_XXS": 16, "IQ2_XS": 17, "IQ3_XXS": 18, "IQ1_S": 19, "IQ4_NL": 20, "IQ3_S": 21, "IQ2_S": 22, "IQ4_XS": 23, "IQ1_M": 29, "BF16": 30, "TQ1_0": 34, "TQ2_0": 35,
}
NAMES = {v: k for k, v in TYPES.items()}
_SCALAR = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
MAGIC, VERSION, ALIGN = b"GGUF", 3, 32


def _read(f: BinaryIO, fmt: str):
    raw = f.read(struct.calcsize(fmt))
    if len(raw) < struct.calcsize(fmt):
        raise ValueError("file ends early")
    return struct.unpack(fmt, raw)[0]


def _string(f: BinaryIO) -> str:
    n = _read(f, "<Q")
    raw = f.read(n)
    if len(raw) < n:
        raise ValueError("file ends early")
    return raw.decode("utf-8")


def _value(f: BinaryIO, kind: int):
    if kind == 8:
        return _string(f)
    if kind == 9:
        inner, n = _read(f, "<I"), _read(f, "<Q")
        return [_value(f, inner) for _ in range(n)]
    if kind not in _SCALAR:
        raise ValueError(f"unknown value type {kind}")
    return _read(f, _SCALAR[kind])


def read_header(path: str) -> tuple[dict, list[dict], int]:
    """Metadata, tensors (name, dtype, shape outermost first, start, size) and where the data begins."""
    with open(path, "rb") as f:
        if f.read(4) != MAGIC or _read(f, "<I") not in (2, VERSION):
            raise ValueError(f"{path}: not a GGUF file of a known version")
        count, pairs = _read(f, "<Q"), _read(f, "<Q")
        meta = {}
        for _ in range(pairs):
            key = _string(f)
            meta[key] = _value(f, _read(f, "<I"))
        tensors = []
        for pos in range(count):
            name, dims = _string(f), _read(f, "<I")
            shape = [_read(f, "<Q") for _ in range(dims)]
            kind, start = _read(f, "<I"), _read(f, "<Q")
            dtype = NAMES.get(kind)
            size = None
            if dtype:
                per, width = BLOCKS[dtype]
                size = int(np.prod(shape, dtype=np.int64)) // per * width
            tensors.append({"pos": pos, "name": name, "dtype": dtype or f"type {kind}", "shape": shape[::-1], "start": start, "size": size})
        align = meta.get("general.alignment", ALIGN)
        begin = -(-f.tell() // align) * align
    return meta, tensors, begin


def _pack_string(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<Q", len(raw)) + raw


def _pack_value(v) -> bytes:
    if isinstance(v, bool):
        return struct.pack("<I?", 7, v)
    if isinstance(v, int):
        return struct.pack("<II", 4, v) if 0 <= v < 1 << 32 else struct.pack("<Iq", 11, v)
    if isinstance(v, float):
        return struct.pack("<If", 6, v)
    if isinstance(v, list):
        return struct.pack("<II", 9, 8) + struct.pack("<Q", len(v)) + b"".join(map(_pack_string, v))
    return struct.pack("<I", 8) + _pack_string(str(v))


def write(path: str, meta: dict, tensors: Iterator[tuple[str, str, list[int], bytes]]) -> None:
    """Writes (name, dtype, shape outermost first, bytes); into a file beside the target first, then renamed."""
    rows = list(tensors)
    head = MAGIC + struct.pack("<IQQ", VERSION, len(rows), len(meta)) + b"".join(_pack_string(k) + _pack_value(v) for k, v in meta.items())
    at = 0
    for name, dtype, shape, data in rows:
        per, width = BLOCKS[dtype]
        if shape and shape[-1] % per:
            raise ValueError(f"{name}: rows of {shape[-1]} don't hold whole blocks of {per}")
        if len(data) != int(np.prod(shape, dtype=np.int64)) // per * width:
            raise ValueError(f"{name}: wrong number of bytes")
        head += _pack_string(name) + struct.pack("<I", len(shape)) + b"".join(struct.pack("<Q", x) for x in shape[::-1]) + struct.pack("<IQ", TYPES[dtype], at)
        at += -(-len(data) // ALIGN) * ALIGN
    tmp = f"{path}.tmp"
    with open(tmp, "wb") as f:
        f.write(head + b"\0" * (-len(head) % ALIGN))
        for _, _, _, data in rows:
            f.write(data + b"\0" * (-len(data) % ALIGN))
    os.replace(tmp, path)


def read_importance(path: str) -> dict[str, np.ndarray]:
    """Weights by tensor name from a GGUF file of sums and counts, or from the older binary layout."""
    with open(path, "rb") as f:
        is_gguf = f.read(4) == MAGIC
    out = {}
    if is_gguf:
        meta, tensors, begin = read_header(path)
        for key in ("imatrix.datasets", "imatrix.chunk_count", "imatrix.chunk_size"):
            if key not in meta:
                raise ValueError(f"{path}: no {key}")
        found: dict[str, dict[str, np.ndarray]] = {}
        with open(path, "rb") as f:
            for t in tensors:
                name, _, part = t["name"].rpartition(".")
                if part in ("in_sum2", "counts"):
                    f.seek(begin + t["start"])
                    found.setdefault(name, {})[part] = np.frombuffer(f.read(t["size"]), np.float32)
        for name, x in found.items():
            if len(x) != 2 or not len(x["counts"]) or len(x["in_sum2"]) % len(x["counts"]):
                raise ValueError(f"{path}: {name} lacks sums or counts, or they don't match")
            sums = x["in_sum2"].reshape(len(x["counts"]), -1)
            count = x["counts"][:, None]
            out[name] = np.where(count > 0, sums / np.where(count > 0, count, 1), np.float32(1)).astype(np.float32).reshape(-1)
    else:
        with open(path, "rb") as f:
            for _ in range(_read(f, "<i")):
                n = _read(f, "<i")
                name = f.read(n).decode()
                calls, width = _read(f, "<i"), _read(f, "<i")
                sums = np.frombuffer(f.read(4 * width), np.float32)
                if len(sums) != width:
                    raise ValueError("file ends early")
                out[name] = sums / np.float32(calls) if calls > 0 else sums
    for name, w in out.items():
        if not np.isfinite(w).all():
            raise ValueError(f"{path}: {name} isn't finite")
    return out


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"].removeprefix("file://"), options.get("payload", "false").lower() == "true"

    def partitions(self) -> list[_File]:
        if os.path.isdir(self.path):
            return [_File(f"{self.path}/{f}") for f in sorted(os.listdir(self.path)) if f.endswith(".gguf")]
        return [_File(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        _, tensors, begin = read_header(partition.path)
        with open(partition.path, "rb") as f:
            for t in tensors:
                row = (partition.path, t["pos"], t["name"], t["dtype"], t["shape"])
                if self.payload:
                    f.seek(begin + t["start"])
                    row += (f.read(t["size"] or 0),)
                yield row


class GgufSource(DataSource):
    """``spark.read.format("gguf").load(...)``: (file, pos, name, dtype, shape) and, with payload=true, data."""

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return "file string, pos long, name string, dtype string, shape array<long>" + (", data binary" if self.options.get("payload", "false").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
