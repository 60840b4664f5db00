"""Structured Streaming into a table, under its constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..tables import Database


def ingest(database: Database, name: str, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Insert every micro-batch as one statement: it takes effect as a whole, or the query stops with the error.

    The database knows the last batch of each checkpoint, and its dumps do: a batch that Spark
    gives again after a restart, and that is in the tables already, is left out."""

    def add(batch: DataFrame, number: int) -> None:
        if number > database.batches.get(checkpoint, -1):
            database.insert(name, batch, batch.columns)
            database.batches[checkpoint] = number

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
