"""Embedding near-duplicates: an exact metric range join on cosine similarity.

Pivots partition the unit vectors; a vector's home is the cell of its nearest pivot.  Angles obey the triangle
inequality, so a vector meets linked vectors of another cell only if it is near the border of that cell: within the
range of the half space between the two pivots, and no further from that pivot than from its own plus twice the
range.  It is replicated to those cells, of two cells to one, and cells join independently.  A cell's vectors
are packed into blocks of bounded size, replicas by the block they come from; what travels is a row for each block, and each
pair of blocks is compared by itself, so hot cells are no larger tasks.

Where vectors lie in all directions alike no bound tells cells apart and every pair has to be compared.  More cells would only make
more replicas, so there are as many as a sample bears; blocks are as large as memory allows, so that each travels few times.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.components import components
from weft.llm.work import Work, map_arrow, session_of

#: Vectors in a cell at least, on average.  Of n vectors up to sqrt(n) are pivots.
CELL = 2048
#: Cells that a vector of a sample of about so many is replicated to on average, at most; with more, there are fewer pivots.
REPLICAS, SAMPLE = 4, 20_000
#: A block holds this part of all vectors, but so many vectors at least, and so many numbers at most if these are more.
PART, BLOCK, NUMBERS = 8, 1024, 1 << 20
#: Numbers in a matrix of vectors by pivots, or by vectors.
MATRIX = 1 << 22


def unit_rows(col: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Unit vectors in double precision by length of vector: (row numbers, matrix).  Unusable vectors are left out."""
    values = pa.array(col.values) if not isinstance(col, pa.ChunkedArray) else col.combine_chunks().values
    off = col.offsets.to_numpy()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
    size, there = np.diff(off), np.asarray(col.is_valid())
    rows, mats = [], []
    for d in np.unique(size[there]):
        if d == 0:
            continue
        at = np.flatnonzero(there & (size == d))
        x = flat[off[at][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1) > 0)
        rows.append(at[good])
        mats.append(units(x[good]))
    return rows, mats


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, _ = unit_rows(batch.column("v"))
        yield batch.take(pa.array(np.sort(np.concatenate(rows)) if rows else np.zeros(0, np.int64)))


def _assign(pivots, least: float) -> Callable:
    """Rows (rep, mult, v, dim, home, cells): the home cell, and cells that the vector is replicated to; of two cells the lower one takes replicas if their sum is even."""
    reach, sine = math.acos(least), math.sin(math.acos(least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in zip(*unit_rows(batch.column("v")), strict=True):
                p = pivots.value.get(x.shape[1], np.eye(1, x.shape[1]))
                step = max(1, MATRIX // len(p))
                for i in range(0, len(x), step):
                    yield part(batch, at[i : i + step], x[i : i + step], p)

    def part(batch: pa.RecordBatch, at: np.ndarray, x: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        dots = x @ p.T
        home = dots.argmax(axis=1)
        best = dots[np.arange(len(x)), home]
        apart = np.sqrt(np.maximum(2 - 2 * p[home] @ p.T, 0))
        near = best[:, None] - dots <= sine * apart + 1e-9
        angle = np.arccos(np.clip(dots, -1, 1))
        near &= angle <= np.arccos(np.clip(best, -1, 1))[:, None] + 2 * reach + 1e-9
        cell = np.arange(len(p))
        near &= np.where((home[:, None] + cell) % 2 == 0, cell < home[:, None], cell > home[:, None])
        rows = batch.take(pa.array(at))
        count, cells = near.sum(axis=1), np.nonzero(near)[1]
        cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(cells, pa.int32()))
        dim = pa.array(np.full(len(x), x.shape[1]), pa.int32())
        return pa.RecordBatch.from_arrays([rows.column("rep"), rows.column("mult"), rows.column("v"), dim, pa.array(home, pa.int32()), cells], ["rep", "mult", "v", "dim", "home", "cells"])

    return run


def _pack(group: pa.Table) -> pa.Table:
    """The block of one group (dim, home, k): a row for its home cell, and one with its replicas for each cell that has any."""
    home, k, dim = (group.column(c)[0].as_py() for c in ("home", "k", "dim"))
    group = group.combine_chunks()
    v = group.column("v").combine_chunks()
    (at,), _ = unit_rows(v)
    x = v.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
    x = x if x.dtype == np.float32 else x.astype(np.float64)
    reps, mult = group.column("rep").to_numpy()[at], group.column("mult").to_numpy()[at]
    cells = group.column("cells").combine_chunks().take(pa.array(at))
    of, cell = np.repeat(np.arange(len(at)), np.diff(cells.offsets.to_numpy())), cells.flatten().to_numpy()
    parts = [(home, np.arange(len(at))), *((int(c), of[cell == c]) for c in np.unique(cell))]
    columns = {"dim": [dim] * len(parts), "cell": [c for c, _ in parts], "home": [home] * len(parts), "k": [k] * len(parts)}
    columns = {c: pa.array(v, pa.int32()) for c, v in columns.items()}
    return pa.table(columns | {c: pa.array([v[own].tobytes() for _, own in parts], pa.binary()) for c, v in (("reps", reps), ("mults", mult), ("x", x))})


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    dot = math.fsum((x * y).tolist())
    return dot / (math.sqrt(math.fsum((x * x).tolist())) * math.sqrt(math.fsum((y * y).tolist())))


def _local_roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of n nodes reaches by the links a-b."""
    label = ids.copy()
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        if (label == before).all():
            return label


def _compare(least: float) -> Callable:
    """Compares two blocks, or a block with itself (then the second is null): (rep, links, root) of linked vectors."""

    def pair(row: dict) -> pa.RecordBatch:
        sides = [(row[f"reps{i}"], row[f"mults{i}"], row[f"x{i}"]) for i in (1, 2) if row[f"reps{i}"] is not None]
        reps, mult = (np.frombuffer(b"".join(s[j] for s in sides), np.int64) for j in (0, 1))
        x = b"".join(s[2] for s in sides)
        x = units(np.frombuffer(x, np.float32 if len(x) == 4 * len(reps) * row["dim"] else np.float64).reshape(len(reps), -1).astype(np.float64))
        split = len(sides[0][0]) // 8
        alone = len(sides) == 1
        other = np.arange(0 if alone else split, len(reps))
        links, tied_a, tied_b = np.zeros(len(reps)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(reps)
        step = max(1, min(512, MATRIX // max(1, len(other))))
        for i in range(0, split, step):
            rows = np.arange(i, min(i + step, split))
            s = x[rows] @ x[other].T
            a, b = np.nonzero(s >= least - 1e-9)
            if alone:
                later = rows[a] < other[b]
                a, b = a[later], b[later]
            close = np.abs(s[a, b] - least) < 1e-9
            a, b = rows[a], other[b]
            if close.any():
                ok = np.array([not c or _exact(x[p], x[q]) >= least for c, p, q in zip(close, a, b, strict=True)], bool)
                a, b = a[ok], b[ok]
            links += np.bincount(a, mult[b], len(x)) + np.bincount(b, mult[a], len(x))
            tied_a, tied_b = np.concatenate([tied_a, a]), np.concatenate([tied_b, b])
            if len(tied_a) > MATRIX // 4:  # a link to the root says as much
                root = _local_roots(len(x), tied_a, tied_b, reps)
                tied_a = np.flatnonzero(root != reps)
                tied_b = order[np.searchsorted(reps, root[tied_a], sorter=order)]
        some = links > 0
        return pa.record_batch({"rep": pa.array(reps[some], pa.int64()), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(_local_roots(len(x), tied_a, tied_b, reps)[some], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pair(batch.slice(i, 1).to_pylist()[0])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """(id, n_links, component_id) for every row of ``vectors``: links are pairs of rows with cosine >= ``least``.

    Cosines are in double precision, those within 1e-9 of the limit are summed exactly.  Vectors that are null, empty, zero
    or hold null or non-finite numbers link with nothing, nor do vectors of different lengths; a null id links with nothing
    and has a null component.  Equal vectors are compared once and counted with their number.  Rows that repeat an
    id count as vectors of their own and share its component.  Other columns are ignored, whatever their names.
    """
    spark = session_of(vectors)
    work = Work(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    usable = map_arrow(rows.where("id is not null and v is not null"), _usable, f"id long, v {rows.schema['v'].dataType.simpleString()}, h1 long, h2 long")
    classes = work.keep(usable.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.any_value("v").alias("v")))
    n = classes.count()
    count = max(1, min(n // CELL, math.isqrt(n)))
    drawn = [r.v for r in classes.orderBy(F.xxhash64("rep")).limit(count).collect()]
    schema = f"rep long, mult long, v {rows.schema['v'].dataType.simpleString()}, dim int, home int, cells array<int>"

    def deal(rows: DataFrame) -> DataFrame:
        by_dim: dict[int, list[list[float]]] = {}
        for v in drawn[:count]:
            by_dim.setdefault(len(v), []).append(v)
        pivots = spark.sparkContext.broadcast({d: unit_rows(pa.array(p, pa.list_(pa.float64())))[1][0] for d, p in by_dim.items()})
        return map_arrow(rows.select("rep", "mult", "v"), _assign(pivots, least), schema)

    sample = classes.where(F.pmod(F.xxhash64("h1", "h2"), F.lit(n // SAMPLE + 1)) == 0)
    while count > 1 and (mean := deal(sample).agg(F.avg(F.size("cells"))).first()[0] or 0) > REPLICAS:
        count = max(1, min(count - 1, int(count * REPLICAS / mean)))
    dealt = work.keep(deal(classes))

    size = F.expr(f"greatest({BLOCK}, least({n // PART}, {NUMBERS} div dim))")
    homes = F.broadcast(work.keep(dealt.groupBy("dim", "home").agg(F.ceil(F.count("*") / size).cast("int").alias("h"))))  # a row for each pivot
    blocks = dealt.join(homes, ["dim", "home"]).withColumn("k", F.pmod(F.xxhash64("rep"), F.col("h")).cast("int")).drop("h")
    blocks = work.keep(blocks.groupBy("dim", "home", "k").applyInArrow(_pack, "dim int, cell int, home int, k int, reps binary, mults binary, x binary"))
    # A block meets the blocks of its own cell from its own on, and its replicas all blocks of the cell that they are in.
    met = blocks.select("dim", "cell", "home", "k").join(homes.withColumnsRenamed({"home": "cell"}), ["dim", "cell"])
    met = met.withColumn("a", F.explode(F.when(F.col("home") == F.col("cell"), F.sequence(F.lit(0), F.col("k"))).otherwise(F.sequence(F.lit(0), F.col("h") - 1))))
    payload = ["reps", "mults", "x"]
    first = blocks.where("home = cell").select("dim", "cell", F.col("k").alias("a"), *[F.col(c).alias(f"{c}1") for c in payload])
    second = blocks.select("dim", "cell", "home", "k", *[F.col(c).alias(f"{c}2") for c in payload])
    itself = (F.col("home") == F.col("cell")) & (F.col("k") == F.col("a"))
    pairs = met.join(second, ["dim", "cell", "home", "k"]).join(first, ["dim", "cell", "a"])
    pairs = pairs.select("dim", *[f"{c}1" for c in payload], *[F.when(~itself, F.col(f"{c}2")).alias(f"{c}2") for c in payload])
    found = work.keep(map_arrow(pairs, _compare(least), "rep long, links long, root long"))

    comps = components(work, found.select("rep", "root"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = classes.select("h1", "h2", "rep", "mult").join(links, "rep", "left").join(comps, F.col("rep") == F.col("id"), "left")
    by_class = by_class.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = F.col("id").isNotNull()
    out = rows.drop("v").join(by_class, known & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(known, F.coalesce("component_id", "id")).alias("component_id"))
