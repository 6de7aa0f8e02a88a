"""Tensor containers with a JSON header: a data source that reads and writes them.

``spark.read.format("safetensors").load(folder or file)`` gives a row for each tensor: (file, shard, pos, name, dtype,
shape, start, end) and, with option payload=true, its bytes as ``data``.  Without payloads only headers are read.  One
partition is one file; a task seeks to its tensors' bytes.  Files must be on a file system that all executors mount.

``df.write.format("safetensors").mode("append").save(file)`` takes (pos, name, dtype, shape, data): tasks write their
payloads beside the target, the commit writes the header and puts them together in the order of pos, then renames.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from weft.plans.validate import ELEMENT

_COLUMNS = "file string, shard int, pos long, name string, dtype string, shape array<long>, start long, `end` long"


class ContainerError(ValueError):
    """A file that isn't a well-formed container."""


def parse_header(raw: bytes) -> tuple[list[dict], dict[str, str]]:
    """Tensors in the header's order (name, dtype, shape, start, end) and the metadata."""
    try:
        found = json.loads(raw.decode("utf-8"))
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise ContainerError(f"header isn't JSON: {e}") from e
    if not isinstance(found, dict):
        raise ContainerError("header isn't an object")
    meta = found.pop("__metadata__", {})
    if not isinstance(meta, dict):
        raise ContainerError("metadata isn't an object")
    tensors = []
    for pos, (name, t) in enumerate(found.items()):
        if not isinstance(t, dict):
            raise ContainerError(f"{name}: entry isn't an object")
        dtype, shape, offsets = t.get("dtype"), t.get("shape"), t.get("data_offsets")
        if dtype not in ELEMENT:
            raise ContainerError(f"{name}: unknown dtype {dtype!r}")
        if not isinstance(shape, list) or not all(isinstance(x, int) and x >= 0 for x in shape):
            raise ContainerError(f"{name}: bad shape")
        if not isinstance(offsets, list) or len(offsets) != 2 or not all(isinstance(x, int) for x in offsets):
            raise ContainerError(f"{name}: bad data_offsets")
        tensors.append({"pos": pos, "name": name, "dtype": dtype, "shape": shape, "start": offsets[0], "end": offsets[1]})
    return tensors, meta


def check_header(tensors: list[dict], length: int) -> None:
    """Offsets must lie within the data and hold exactly the shape's elements."""
    for t in tensors:
        size = ELEMENT[t["dtype"]]
        for x in t["shape"]:
            size *= x
        if not 0 <= t["start"] <= t["end"] <= length:
            raise ContainerError(f"{t['name']}: offsets out of range")
        if t["end"] - t["start"] != size:
            raise ContainerError(f"{t['name']}: {t['end'] - t['start']} bytes for {size}")


def open_header(path: str) -> tuple[list[dict], dict[str, str], int]:
    """Tensors, metadata and where the data begins."""
    whole = os.path.getsize(path)
    with open(path, "rb") as f:
        prefix = f.read(8)
        if len(prefix) < 8:
            raise ContainerError(f"{path}: too short")
        (n,) = struct.unpack("<Q", prefix)
        if n < 8 or n % 8 or n > whole - 8:
            raise ContainerError(f"{path}: header of {n} bytes")
        tensors, meta = parse_header(f.read(n).rstrip(b" "))
    check_header(tensors, whole - 8 - n)
    return tensors, meta, 8 + n


def header_bytes(tensors: list[dict], meta: dict[str, str]) -> bytes:
    """The length prefix and the header, padded with spaces to a multiple of 8 bytes."""
    out = {"__metadata__": meta} if meta else {}
    out |= {t["name"]: {"dtype": t["dtype"], "shape": list(t["shape"]), "data_offsets": [t["start"], t["end"]]} for t in tensors}
    raw = json.dumps(out, separators=(",", ":"), ensure_ascii=False).encode()
    raw += b" " * (-len(raw) % 8)
    return struct.pack("<Q", len(raw)) + raw


def files_of(path: str) -> list[str]:
    """A file, or a folder's files: those of its index in the order in which it first names them, else sorted."""
    path = path.removeprefix("file://")
    if os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        raise ContainerError(f"{path}: no such file or folder")
    index = [f for f in sorted(os.listdir(path)) if f.endswith(".safetensors.index.json")]
    if index:
        with open(f"{path}/{index[0]}") as f:
            names = dict.fromkeys(json.load(f)["weight_map"].values())
    else:
        names = [f for f in sorted(os.listdir(path)) if f.endswith(".safetensors")]
    return [f"{path}/{n}" for n in names]


@dataclass
class _File(InputPartition):
    path: str
    shard: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "false").lower() == "true"

    def partitions(self) -> list[_File]:
        return [_File(f, i) for i, f in enumerate(files_of(self.path))]

    def read(self, partition: _File) -> Iterator[tuple]:
        tensors, _, begin = open_header(partition.path)
        with open(partition.path, "rb") as f:
            for t in tensors:
                row = (partition.path, partition.shard, t["pos"], t["name"], t["dtype"], t["shape"], t["start"], t["end"])
                if self.payload:
                    f.seek(begin + t["start"])
                    row += (f.read(t["end"] - t["start"]),)
                yield row


@dataclass
class _Part(WriterCommitMessage):
    path: str
    tensors: list[dict]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.meta = json.loads(options.get("metadata", "{}"))
        self.token = uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Part:
        part, tensors, at = f"{self.path}.{self.token}.{uuid.uuid4().hex}.part", [], 0
        with open(part, "wb") as f:
            for r in rows:
                data = bytes(r["data"])
                f.write(data)
                tensors.append({"pos": r["pos"], "name": r["name"], "dtype": r["dtype"], "shape": list(r["shape"]), "at": at, "size": len(data)})
                at += len(data)
        return _Part(part, tensors)

    def commit(self, messages: list[_Part | None]) -> None:
        parts = [m for m in messages if m is not None]
        places, at = [], 0
        for pos, path, t in sorted(((t["pos"], m.path, t) for m in parts for t in m.tensors), key=lambda x: (x[0], x[2]["name"])):
            places.append((path, t | {"start": at, "end": at + t["size"]}))
            at += t["size"]
        check_header([t for _, t in places], at)
        tmp = f"{self.path}.{self.token}.tmp"
        with open(tmp, "wb") as out:
            out.write(header_bytes([t for _, t in places], self.meta))
            for path, t in places:
                with open(path, "rb") as f:
                    f.seek(t["at"])
                    left = t["size"]
                    while left:
                        chunk = f.read(min(left, 1 << 24))
                        out.write(chunk)
                        left -= len(chunk)
        os.replace(tmp, self.path)
        self.abort(messages)

    def abort(self, messages: list[_Part | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class SafetensorsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return _COLUMNS + (", data binary" if self.options.get("payload", "false").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats "safetensors" and "gguf" known to the session."""
    from weft.session import ship_package
    from weft.sources.gguf import GgufSource

    ship_package(spark)
    spark.dataSource.register(SafetensorsSource)
    spark.dataSource.register(GgufSource)
