"""Shared plumbing of the operators: the shared work folder, size-checked joins, schemas."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.session import ship_package

#: Rows and bytes handed to a Python worker at once: the bytes bound batches of texts, the rows those of numbers.
ROWS_PER_BATCH, BYTES_PER_BATCH = 20_000, 1 << 20
#: A join side of up to this many rows (of two longs or so) may be broadcast.
BROADCAST_ROWS = 500_000


def session_of(df: DataFrame) -> SparkSession:
    """The session of ``df``, with Arrow batches small enough for whole texts."""
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and all is on one machine (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or "file://" + os.path.join(tempfile.gettempdir(), "weft-work")


class Work:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and return a DataFrame that reads it."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weft_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that :meth:`keep` wrote and that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._weft_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def steady(work: Work, df: DataFrame) -> DataFrame:
    """``df`` itself if it does nothing but read files, so that every scan numbers its rows alike; else a kept copy of it."""
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName().split(" ")[0] not in ("LogicalRelation", "Project", "Filter"):
            return work.keep(df)
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as keep it apart from the columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str = "__uid") -> DataFrame:
    """``df``, which must be :func:`steady`, with ``name`` (a free one), the row's number, as the operators give it."""
    return df.select("*", F.monotonically_increasing_id().alias(name))


def without_rows(df: DataFrame, gone: DataFrame, rows: int) -> DataFrame:
    """``df`` without the rows numbered in the one column of ``gone``; broadcast only where ``rows`` (its count) is in bounds."""
    uid = free_name(df, "__uid")
    gone = gone.toDF(uid)
    return numbered(df, uid).join(F.broadcast(gone) if rows <= BROADCAST_ROWS else gone, uid, "left_anti").drop(uid)


def spread_join(df: DataFrame, keyed: DataFrame, key: str, bound: int = BROADCAST_ROWS // 10, ways: int = 16) -> DataFrame:
    """``df`` left-joined with ``keyed`` (kept, one row for each key): broadcast within ``bound`` rows, else each key's rows go several ways."""
    if keyed.count() <= bound:
        return df.join(F.broadcast(keyed), key, "left")
    several = keyed.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return df.withColumn("_way", F.pmod(F.xxhash64("uid"), F.lit(ways)).cast("int")).join(several, [key, "_way"], "left").drop("_way")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def binary_column(col: pa.Array) -> pa.Array:
    """A string column as UTF-8 bytes without nulls (null: empty)."""
    return (col.fill_null("") if col.null_count else col).cast(pa.large_binary())


def sum_counts(parts: DataFrame, slices: int) -> dict[int, np.ndarray]:
    """Sums of the ``counts`` (32-bit numbers) of each ``slice``; rows stream through their task one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                own = np.frombuffer(c.as_buffer(), np.uint32)
                total[s] = total[s] + own if s in total else own.astype(np.uint64)
        yield pa.record_batch({"slice": pa.array(list(total), pa.int32()), "counts": pa.array([t.tobytes() for t in total.values()], pa.binary())})

    rows = map_arrow(parts.select("slice", "counts").repartition(slices, "slice"), run, "slice int, counts binary").collect()
    return {r.slice: np.frombuffer(r.counts, np.uint64) for r in rows}


def running_total(work: Work, df: DataFrame, order: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``out``, the running total of the long column ``value`` in the order of the columns ``order``.

    Rows are range-sorted; each partition sums its own rows, then gets the total of the partitions before it.
    So a source with any part of all rows is spread over tasks, and only one number for each partition is joined.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            own = np.cumsum(batch.column(value).to_numpy(zero_copy_only=False)) + total
            total = int(own[-1]) if len(own) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64()), pa.array([part] * len(own), pa.int32())], [*batch.schema.names, out, "_part"])

    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    own = work.keep(map_arrow(ranged, run, ", ".join([*names, f"{out} long", "_part int"])))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("_part").agg(F.max(out).alias("_sum"))
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(sums), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")
