"""Incremental indexing: new record documents become versions as they arrive.

The file source's checkpoint remembers what was read; each micro-batch keeps the newest version of
a declaration and appends it only if it is newer than what is current, so a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import VERSION, Store, newer

DOCUMENT = "epd_uid string, version int, saved_at timestamp, content_hash string, note string, record string"


def reconcile(store: Store, source: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follow a folder of JSON documents of versions."""
    stream = store.spark.readStream.schema(DOCUMENT).option("recursiveFileLookup", "true").json(source)

    columns = [c.split()[0] for c in VERSION.split(", ")]

    def apply(batch: DataFrame, _: int) -> None:
        rows = batch.where("epd_uid IS NOT NULL AND version IS NOT NULL")
        store.append_versions(lambda current: newer(rows, current).select(columns))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_by_window(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of a type in tumbling windows; what comes later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
