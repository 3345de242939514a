"""Append-only patches as a stream: each micro-batch is one idempotent save."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from provloom.operators.store import Store


def follow(patches: DataFrame, store: Store, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Save every micro-batch of ``patches`` into a table; a batch that is run again changes nothing."""
    writer = patches.writeStream.foreachBatch(lambda rows, number: store.save(table, rows, f"stream-{number}")).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
