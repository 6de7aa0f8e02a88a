"""New rows of weight matrices quantized as they arrive, each once: a streaming source, one scheme, a checkpointed sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def quantize_stream(spark: SparkSession, source: str, schema: StructType, prepare: Callable[[DataFrame], DataFrame], scheme: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Reads new Parquet files of ``source``, and appends what ``scheme`` makes of them to ``target``.

    ``prepare`` maps a batch to (tensor, row_id, v).  A batch is one set of files, so schemes with a scale for each row or
    slice give what they would in one go; those with a scale for a tensor see the tensor's rows of a batch.
    Files that a checkpoint lists as done aren't read again after a restart.
    """

    def batch(rows: DataFrame, number: int) -> None:
        scheme(prepare(rows)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
