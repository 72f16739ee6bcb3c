"""Queues as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.queues import after_failure


def accepted_stream(messages: DataFrame, keep: str | None = None) -> DataFrame:
    """The first message of each idempotency key.

    Keys are kept for ever, or, with `keep` (such as "7 days"), for that long after a message's creation, which bounds the state.
    """
    if keep is None:
        return messages.dropDuplicates(["idempotency_key"])
    timed = messages.withColumn("_at", F.timestamp_millis("created_at_ms")).withWatermark("_at", keep)
    return timed.dropDuplicatesWithinWatermark(["idempotency_key"]).drop("_at")


def routed_stream(failed: DataFrame, retry_path: str, dlq_path: str, checkpoint: str, most: int = 3):
    """Write failed messages to the retry or dead-letter folder; a repeated batch overwrites its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        routed = after_failure(batch, most)
        for route, path in (("retry", retry_path), ("dlq", dlq_path)):
            routed.filter(F.col("route") == route).drop("route").write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return failed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
