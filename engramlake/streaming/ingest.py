"""Nodes that arrive as a stream, appended as revisions a micro-batch at a time. The memory model itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from engramlake.operators.lifecycle import insert


def ingest(stream: DataFrame, path: str, checkpoint: str, tenant: int, clock) -> StreamingQuery:
    """Appends each batch of new nodes to the revisions at path, which exist; a batch replayed after a failure overwrites its own.

    clock: a function giving the time in milliseconds.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(path)
        known = known.where(f"input_file_name() not like '%/batch={batch_id}/%'")
        insert(known, batch, tenant, clock()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
