"""Structured Streaming into and out of the log.

``ingest`` turns each micro-batch into one log entry that carries the batch's name; the log
takes each name once, so a batch replayed after a failure, at whatever point, is written
once.  ``index_available`` follows the log's entries as a stream of files and extends the
index up to the newest; entries have no gaps, whatever the order in which files are seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Namespace
from ..types import IndexConfig

#: Writes are gathered for this long before they become a log entry.
BATCH_WINDOW = "500 milliseconds"


def ingest(stream: DataFrame, ns: Namespace, checkpoint: str, name: str = "ingest", once: bool = False, window: str = BATCH_WINDOW) -> StreamingQuery:
    """Write a stream of (op, id, vector, attributes) rows, or of documents, to the log."""

    def write(batch: DataFrame, batch_id: int) -> None:
        source = f"{name}-{batch_id}"
        if ns.store.has_source(ns.name, source) or batch.isEmpty():
            return
        if "op" in batch.columns:
            held = batch.persist()
            ns.write([("upsert", held.where("op = 'upsert'")), ("delete", held.where("op = 'delete'"))], source)
            held.unpersist()
        else:
            ns.write([("upsert", batch)], source)

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=window)).start()


def index_available(ns: Namespace, checkpoint: str, config: IndexConfig | None = None) -> StreamingQuery:
    """Index what the log has now, driven by its entries; ends when they are done."""
    entries = ns.spark.readStream.text(ns.store.path(ns.name, "wal", "entries"))

    def extend(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ns.build_index(config)

    return entries.writeStream.foreachBatch(extend).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
