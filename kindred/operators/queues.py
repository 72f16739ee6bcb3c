"""Job queues as tables: idempotent enqueue, order, retry, dead letters, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The queues. The tracking ones are declared but nothing writes to them.
QUEUES = ("discovery", "rescan", "tracking_start", "tracking_monitor", "dlq")


def envelope(rows: DataFrame, payload: list[str]) -> DataFrame:
    """Messages as JSON text: metadata and the payload columns."""
    body = F.to_json(F.struct("message_type", "job_id", "idempotency_key", "created_at_ms", "attempt", F.struct(*payload).alias("payload")))
    return rows.select("queue", "seq", body.alias("body"))


def accepted(rows: DataFrame) -> DataFrame:
    """Every message with whether it is a repeat of an earlier key; all queues share their keys."""
    w = Window.partitionBy("idempotency_key").orderBy("seq")
    return rows.withColumn("deduplicated", F.row_number().over(w) > 1)


def enqueue(rows: DataFrame) -> DataFrame:
    """The first message of each key; keys are reduced by map-side minima, so a very common key costs one row per task."""
    first = rows.groupBy("idempotency_key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "idempotency_key"]), "seq").alias("m"))
    return first.select("idempotency_key", "m.*").select(*rows.columns)


def route_failure(attempt: Column, most: int = 3) -> Column:
    """Where a failed message goes: to the dead letters when its next attempt would reach `most`."""
    return F.when(attempt + 1 >= most, "dlq").otherwise("retry")


def after_failure(rows: DataFrame, most: int = 3) -> DataFrame:
    """Failed messages at their next place: retries count one attempt more, dead letters keep their text as it was."""
    route = route_failure(F.col("attempt"), most)
    return rows.withColumn("route", route).withColumn("attempt", F.when(F.col("route") == "retry", F.col("attempt") + 1).otherwise(F.col("attempt")))


def peek(rows: DataFrame, queue: str, n: int) -> DataFrame:
    """The first n messages of a queue, one at least, which stay in it."""
    return rows.filter(F.col("queue") == queue).orderBy("seq").limit(max(n, 1))


def depths(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Messages and distinct keys in each declared queue, 0 for empty ones."""
    names = spark.createDataFrame([(q,) for q in QUEUES], "queue string")
    found = rows.groupBy("queue").agg(F.count("*").alias("depth"), F.countDistinct("idempotency_key").alias("keys"))
    return names.join(found, "queue", "left").select("queue", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("keys", F.lit(0)).alias("keys"))


def reported_depth(text: Column) -> Column:
    """A depth that a queue service reports as text; 0 where it is no number."""
    return F.coalesce(text.try_cast("long"), F.lit(0))


def in_turn(rows: DataFrame) -> DataFrame:
    """All messages in the order in which a poller takes them: discovery before rescan, each first in, first out."""
    first = F.when(F.col("queue") == "discovery", 0).when(F.col("queue") == "rescan", 1)
    return rows.filter(first.isNotNull()).withColumn("priority", first).orderBy("priority", "seq")


def discovery_key(scan: Column, video: Column, expected: Column) -> Column:
    return F.concat_ws(":", F.lit("discovery"), scan, video, F.coalesce(expected, F.lit(0)).cast("string"))


def rescan_key(scan: Column, expected: Column, splits: Column) -> Column:
    return F.concat_ws(":", F.lit("rescan"), scan, F.coalesce(expected.cast("string"), F.lit("none")), F.array_join(splits.cast("array<string>"), "-"))


def message_ids(kind: Column, at_ms: Column) -> tuple[Column, Column]:
    """The message id and trace id of a message of a kind made at a time."""
    return F.concat_ws("-", F.lit("msg"), kind, at_ms.cast("string")), F.concat_ws("-", F.lit("trace"), kind, (at_ms % 100_000).cast("string"))


def send_options(queue: Column, key: Column, group: str = "kindred") -> tuple[Column, Column]:
    """Group and deduplication id for an ordered queue service; null where the queue's name does not end in .fifo."""
    ordered = queue.endswith(".fifo")
    return F.when(ordered, F.concat_ws("-", F.lit(group), F.split(queue, r"\.")[0])), F.when(ordered, key)
