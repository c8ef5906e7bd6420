"""Streams of changes: into a log-structured store, or as a running latest version of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import latest
from ..sources.log_store import LogStore


def write_stream(changes: DataFrame, store: LogStore, checkpoint: str, name: str, order: list[str], trigger: dict | None = None):
    """Starts a query that appends each micro-batch of changes (key, value, is_tombstone and the order columns) as a run.

    Within a batch the last change of a key in `order` counts. The manifest remembers the stream's last batch, so a batch that is
    replayed after a failure is written once.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = latest(batch.where("key is not null"), "key", order).select("key", F.when(~F.col("is_tombstone"), F.col("value")).alias("value"), "is_tombstone")
        if store.append_run(rows, name, batch_id):
            store.compact()

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_stream(log: DataFrame, time: str = "logical_time") -> DataFrame:
    """Streaming aggregation of a log to (key, value, is_tombstone, logical_time): the newest version of each key, in whatever order
    changes come. For output modes complete and update; tombstones stay, as an older change may still come."""
    best = F.max_by(F.struct("value", "is_tombstone", F.col(time).alias("logical_time")), time)
    return log.groupBy("key").agg(best.alias("v")).select("key", "v.value", "v.is_tombstone", "v.logical_time")
