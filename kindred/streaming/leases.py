"""Receiving with a lease: a message taken is hidden for a while, comes back unless acknowledged, and ends in the dead letters.

State is kept by message, so a queue of any length is spread over tasks. Both processors work in event time (`at_ms` with a watermark) or in
processing time; timers are Spark's, so they outlive the query with its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..cluster import ship

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LEASED = "message_id string, kind string, receipt int, attempt int, at_ms long, body string"
THROTTLED = "key string, at_ms long, value double, last boolean"


class Lease(StatefulProcessor):
    """Rows: kind `sent` (attempt, body), `ack` or `fail` (receipt). Out: `delivered`, `done` or `dlq`.

    A delivery gets the next receipt and is hidden for `lease_ms`. An answer counts if its receipt is the last one and it comes within the
    lease. A failure, or the end of the lease, counts one attempt; at `most` the message goes to the dead letters as it was sent.
    """

    def __init__(self, lease_ms: int, most: int, event_time: bool) -> None:
        self.lease_ms, self.most, self.event_time = lease_ms, most, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "attempt int, receipt int, until long, body string")

    def _deliver(self, key: str, attempt: int, receipt: int, body: str, now: int) -> Row:
        self.held.update((attempt, receipt, now + self.lease_ms, body))
        self.handle.registerTimer(now + self.lease_ms)
        return Row(message_id=key, kind="delivered", receipt=receipt, attempt=attempt, at_ms=now, body=body)

    def _failed(self, key: str, now: int) -> Row:
        attempt, receipt, _, body = self.held.get()
        if attempt + 1 >= self.most:
            self.held.clear()
            return Row(message_id=key, kind="dlq", receipt=receipt, attempt=attempt, at_ms=now, body=body)
        return self._deliver(key, attempt + 1, receipt + 1, body, now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        key = key[0]
        clock = None if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        for r in sorted(rows, key=lambda r: (r.at_ms, r.kind != "sent")):
            now = r.at_ms if clock is None else clock
            while self.held.exists() and self.held.get()[2] < now:  # leases that ended before this row, though their timers come later
                until = self.held.get()[2]
                self.handle.deleteTimer(until)
                yield self._failed(key, until)
            if r.kind == "sent":
                if not self.held.exists():
                    yield self._deliver(key, r.attempt or 0, 1, r.body, now)
            elif self.held.exists():
                attempt, receipt, until, body = self.held.get()
                if r.receipt == receipt and now <= until:
                    self.handle.deleteTimer(until)
                    if r.kind == "ack":
                        self.held.clear()
                        yield Row(message_id=key, kind="done", receipt=receipt, attempt=attempt, at_ms=now, body=body)
                    else:
                        yield self._failed(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            until = self.held.get()[2]
            # in event time a lease ends when it says, however late the watermark tells
            if until <= expiredTimerInfo.getExpiryTimeInMs():
                yield self._failed(key[0], until if self.event_time else timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def leased_stream(rows: DataFrame, lease_ms: int = 30_000, most: int = 3, watermark: str | None = None) -> DataFrame:
    """Deliveries, acknowledgements and dead letters of a stream of message_id, kind, at_ms, receipt, attempt and body.

    With `watermark` (such as "0 seconds") times are those of `at_ms`, else the clock's. The session's state store becomes RocksDB,
    which timers need.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set(*PROVIDER)
    rows = rows.select("message_id", "kind", "at_ms", "receipt", "attempt", "body")
    if watermark:
        rows = rows.withColumn("_time", F.timestamp_millis("at_ms")).withWatermark("_time", watermark)
    return rows.groupBy("message_id").transformWithState(Lease(lease_ms, most, watermark is not None), LEASED, "Append", "EventTime" if watermark else "ProcessingTime")


def lease_outcomes(messages: DataFrame, replies: DataFrame, lease_ms: int = 30_000, most: int = 3) -> DataFrame:
    """message_id, deliveries, outcome (`done` or `dlq`) and at_ms: what the stream gives of whole tables.

    `messages` has message_id, at_ms and attempt, `replies` message_id, receipt, kind and at_ms. A message is delivered `most` times at
    most, each time a join on message and receipt; replies are reduced to the first in time before it.
    """
    now = messages.select("message_id", F.col("at_ms").alias("_from"), F.coalesce("attempt", F.lit(0)).alias("attempt"), F.lit(0).alias("deliveries"), F.lit(None).cast("string").alias("outcome"))
    for receipt in range(1, most + 1):
        mine = replies.filter(F.col("receipt") == receipt).select("message_id", "kind", "at_ms")
        met = now.join(mine, "message_id", "left")
        good = F.col("at_ms").between(F.col("_from"), F.col("_from") + lease_ms)
        met = met.groupBy("message_id", "_from", "attempt", "deliveries", "outcome").agg(F.min(F.when(good, F.struct("at_ms", "kind"))).alias("_r"))
        open_ = F.col("outcome").isNull()
        done, dead = F.col("_r.kind") == "ack", F.col("attempt") + 1 >= most
        now = met.select(
            "message_id", F.when(open_, F.coalesce("_r.at_ms", F.col("_from") + lease_ms)).otherwise(F.col("_from")).alias("_from"),
            F.when(open_ & ~F.coalesce(done, F.lit(False)) & ~dead, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"),
            (F.col("deliveries") + open_.cast("int")).alias("deliveries"),
            F.when(~open_, F.col("outcome")).when(done, "done").when(dead, "dlq").alias("outcome"),
        )
    return now.select("message_id", "deliveries", "outcome", F.col("_from").alias("at_ms"))


class Throttle(StatefulProcessor):
    """Emits a key's first row, each that comes `gap_ms` after the last emitted one, and, once nothing came for `idle_ms`, the last."""

    def __init__(self, gap_ms: int, idle_ms: int, event_time: bool) -> None:
        self.gap_ms, self.idle_ms, self.event_time = gap_ms, idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "emitted long, until long, pending boolean, at_ms long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clock = None if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        emitted = until = None
        if self.held.exists():
            emitted, until = self.held.get()[:2]
        at = value = None
        pending = False
        for r in sorted(rows, key=lambda r: (r.at_ms, r.seq)):
            at, value, pending = r.at_ms, r.value, emitted is not None and r.at_ms - emitted < self.gap_ms
            if not pending:
                emitted = at
                yield Row(key=key[0], at_ms=at, value=value, last=False)
        if at is None:
            return
        if until is not None:
            self.handle.deleteTimer(until)
        until = (at if clock is None else clock) + self.idle_ms
        self.held.update((emitted, until, pending, at, value))
        self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            _, until, pending, at, value = self.held.get()
            if until <= expiredTimerInfo.getExpiryTimeInMs():
                self.held.clear()
                if pending:
                    yield Row(key=key[0], at_ms=at, value=value, last=True)

    def close(self) -> None:
        pass


def throttled_stream(rows: DataFrame, gap_ms: int = 180, idle_ms: int = 5_000, watermark: str | None = None) -> DataFrame:
    """Throttled progress of a stream of key, seq, at_ms and value; a key idle for `idle_ms` is at its end."""
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set(*PROVIDER)
    rows = rows.select("key", "seq", "at_ms", "value")
    if watermark:
        rows = rows.withColumn("_time", F.timestamp_millis("at_ms")).withWatermark("_time", watermark)
    return rows.groupBy("key").transformWithState(Throttle(gap_ms, idle_ms, watermark is not None), THROTTLED, "Append", "EventTime" if watermark else "ProcessingTime")
