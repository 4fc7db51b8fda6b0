"""Postings that arrive as a stream: per micro-batch they are added to a table, from which positions and index are built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends stream(list_id, doc_id) to the Parquet table, each pair once per batch id, until all that is there has been read.

    A batch is a folder of its own that a repeated run overwrites, so a restart adds nothing twice.
    """

    def add(batch: DataFrame, n: int) -> None:
        batch.select("list_id", "doc_id").distinct().write.mode("overwrite").parquet(f"{table}/batch={n}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def postings(spark, table: str) -> DataFrame:
    """(list_id, doc_id) of all batches, distinct."""
    return spark.read.parquet(table).select("list_id", "doc_id").distinct()
