"""Micro-batch ingest: arriving documents become batches of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeseek.plans.collection import Collection


def append_stream(stream: DataFrame, collection: Collection, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream (node_id, id, text, metadata) batch by batch.

    A batch's folder is named by its number, so a batch that the stream delivers again after a restart overwrites what it stored before,
    also in another process over the same collection path. Within a batch a node_id counts once (the larger row); node_ids that are stored
    already in another batch are passed over.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        part = f"stream-{epoch:09d}"
        once_each = batch.groupBy("node_id").agg(F.max(F.struct("id", "text", "metadata")).alias("r")).select("node_id", "r.id", "r.text", "r.metadata")
        others = [p for p in collection._parts if not p.endswith(f"/part-{part}")]
        if others:
            once_each = once_each.join(collection._read("docs", [f"{p}/docs" for p in others]).select("node_id"), "node_id", "left_anti")
        collection.add_frame(once_each, part=part)

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
