"""Continuous ingest: each micro-batch becomes one transaction of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidelog.sources.store import Store


def ingest(stream: DataFrame, store: Store, deleted: str = "deleted", flush_every: int = 8) -> DataStreamWriter:
    """A writer that upserts the rows of a stream (k, values, deleted). A batch that is run again after a failure writes the
    same upserts once more, which changes no state. Every `flush_every` batches the memtable is flushed, and level 0 is
    compacted when it holds more runs than allowed."""

    def batch(rows: DataFrame, n: int) -> None:
        rows = rows.persist()
        with store.begin() as txn:
            txn.put(rows.where(~F.col(deleted)))
            txn.delete(rows.where(deleted))
        rows.unpersist()
        if (n + 1) % flush_every == 0 and store.flush():
            if sum(f["level"] == 0 for f in store.files) > store.options.zero_level_files:
                store.compact(0)

    return stream.writeStream.foreachBatch(batch)
