"""Histories that streams append to, each batch once.

A batch is written under its own number, which replaces what an earlier try left there, and counts once its empty file in the
ledger exists. A batch that is in the ledger is not written again. So retries, replays and lost executors add nothing twice, and
readers never see part of a batch.

Nulls and edges: rows are appended as they are, nulls and repeats included; an empty batch is noted in the ledger and adds nothing;
a history without a batch cannot be read (its columns are unknown) unless a schema is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldglass.functions.stages import mark, names_in


def append_once(path: str, source: str = "stream") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends a batch of ``source`` to the history, unless it has been appended."""

    def append(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"{source}-{batch_id:012d}"
        if name not in names_in(spark, f"{path}/ledger"):
            batch.write.mode("overwrite").parquet(f"{path}/rows/{name}")
            mark(spark, f"{path}/ledger/{name}")

    return append


def record(stream: DataFrame, path: str, checkpoint: str, source: str = "stream") -> StreamingQuery:
    """Starts appending all that the stream has now, batch by batch; ``checkpoint`` remembers what has been read."""
    return stream.writeStream.foreachBatch(append_once(path, source)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_history(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All batches in the ledger."""
    names = names_in(spark, f"{path}/ledger")
    if not names and schema:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*[f"{path}/rows/{n}" for n in names])
