"""Running a stream over what is there now, with results on shared storage.

A drain fails if its watermark left out any row: a finite input has no late rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.ordering import work_path


def _finish(query: StreamingQuery) -> None:
    """Wait for the end, counting the rows that came too late in every micro-batch."""
    late: dict[int, int] = {}
    ended = False
    while not ended:
        ended = query.awaitTermination(1)
        for batch in query.recentProgress:
            late[batch["batchId"]] = max(late.get(batch["batchId"], 0), sum(
                state["numRowsDroppedByWatermark"] for state in batch["stateOperators"]))
    if lost := sum(late.values()):
        raise ValueError(f"{lost} rows came later than the watermark allows; use a longer one or none")


def _start(writer: DataStreamWriter, root: str) -> DataStreamWriter:
    return writer.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)


def drain_append(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input in append mode; the rows land in Parquet."""
    spark = stream.sparkSession
    root = work_path(spark, name)
    _finish(_start(stream.writeStream.outputMode("append").format("parquet"), root).start(f"{root}/rows"))
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def drain_update(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Process all available input in update mode and return the last value per key.

    Each micro-batch writes its changes to its own folder, so a repeated batch
    replaces itself.
    """
    root = work_path(stream.sparkSession, name)

    def save(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")

    _finish(_start(stream.writeStream.outputMode("update").foreachBatch(save), root).start())
    values = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.parquet(f"{root}/rows")
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*keys, "v.*")


def drain_complete(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input in complete mode and return the rows after the last micro-batch."""
    root = work_path(stream.sparkSession, name)
    last = [-1]

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
        last[0] = batch

    _finish(_start(stream.writeStream.outputMode("complete").foreachBatch(save), root).start())
    if last[0] < 0:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows/batch={last[0]}")
