"""Sessions, events and the counter as tables of one store; each change is one version of all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import checkpoints
from ..sources.store import Conflict, Snapshot, Store
from .queues import after_failure
from .review import rescan_applied, rescan_event
from .sessions import latest, maintenance, patch, replace_events, upsert, without

#: What pages of the tables are ordered by.
KEYS = {"sessions": ["updated_at_ms", "scan_id"], "events": ["id"]}


def counter(spark: SparkSession, value: int, key: str = "next_id") -> DataFrame:
    return spark.createDataFrame([(key, value)], "key string, value long")


def retried(store: Store, change: Callable[[Snapshot], dict[str, DataFrame]], tries: int = 5, notes: dict[str, str] | None = None) -> int:
    """Commit what `change` makes of the newest snapshot; if another commit came first, again from that one."""
    for left in range(tries - 1, -1, -1):
        base = store.snapshot()
        try:
            return store.commit(change(base), base, KEYS, notes)
        except Conflict:
            if not left:
                raise
    raise AssertionError("tries must be at least 1")


def replace_all(store: Store, sessions: DataFrame, events: DataFrame, next_id: int) -> int:
    """Both tables and the counter in place of the old ones."""
    return retried(store, lambda _: {"sessions": sessions, "events": events, "counters": counter(store.spark, next_id)})


def save(store: Store, sessions: DataFrame, events: DataFrame, next_id: int) -> int:
    """The given sessions in place of those with their ids, with all of their events; others stay."""
    return retried(store, lambda now: {
        "sessions": upsert(now.table("sessions"), sessions, "scan_id"), "events": replace_events(now.table("events"), events, sessions),
        "counters": upsert(now.table("counters"), counter(store.spark, next_id), "key"),
    })


def update(store: Store, changes: DataFrame, columns: list[str], events: DataFrame | None = None) -> int:
    """The given columns of the sessions that `changes` names and, if given, all of their events."""
    def change(now: Snapshot) -> dict[str, DataFrame]:
        out = {"sessions": patch(now.table("sessions"), changes, "scan_id", columns)}
        return out if events is None else out | {"events": replace_events(now.table("events"), events, changes)}

    return retried(store, change)


def delete(store: Store, keys: DataFrame) -> int:
    """Sessions by id, with their events."""
    return retried(store, lambda now: {"sessions": without(now.table("sessions"), keys), "events": without(now.table("events"), keys)})


def import_legacy(store: Store, legacy: DataFrame) -> int:
    """The legacy sessions beside the stored ones, the later of equal ids; the store is rewritten once and says so."""
    if "imported" in store.snapshot().notes:
        return store.snapshot().version

    def change(now: Snapshot) -> dict[str, DataFrame]:
        old = now.table("sessions")
        new = legacy.select(*[F.col(c) if c in legacy.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])
        # of equal times the stored session stays
        both = old.withColumn("_own", F.lit(1)).unionByName(new.withColumn("_own", F.lit(0)))
        return {"sessions": latest(both, "scan_id", "updated_at_ms", "_own").drop("_own")}

    return retried(store, change, notes={"imported": "legacy"})


def maintained(store: Store, now_ms: int, age_ms: int = 7 * 86_400_000, per_scan: int = 120) -> int:
    """One run of retention as a version of the store, which notes how many runs there were and when the last was."""
    runs = int(store.snapshot().notes.get("maintenance_runs", 0)) + 1

    def change(now: Snapshot) -> dict[str, DataFrame]:
        kept = maintenance(now.table("sessions"), now.table("events"), now_ms, age_ms, per_scan)
        return {"sessions": kept["sessions"], "events": kept["events"]}

    return retried(store, change, notes={"maintenance_runs": str(runs), "maintenance_at_ms": str(now_ms)})


def rescans_processed(store: Store, messages: DataFrame, rescanned: DataFrame, now_ms: int, batch: int, most: int = 3) -> DataFrame:
    """One batch of rescan messages (with scan_id) from the queue to the store; the messages that failed, at their next place.

    A message whose scan is in `rescanned` and is stored succeeds: in one version its session starts review again and an event says
    so. The version notes the batch, so a batch that comes again after a crash changes nothing and fails the same messages. Event ids
    follow the counter, with gaps.
    """
    start = store.snapshot()
    was = int(start.notes["before_batch"]) if start.notes.get("batch") == str(batch) else start.version
    known = store.snapshot(was).table("sessions")
    good = rescanned.select("scan_id").join(known.select("scan_id"), "scan_id", "left_semi").distinct()
    failed = after_failure(messages.join(good, "scan_id", "left_anti"), most)
    if was != start.version:
        return failed
    wanted = good.join(messages.select("scan_id"), "scan_id", "left_semi")

    def change(now: Snapshot) -> dict[str, DataFrame]:
        changes = rescan_applied(now.table("sessions"), wanted, now_ms)
        columns = [c for c in changes.columns if c != "scan_id" and c in now.table("sessions").columns]
        next_id = now.table("counters").filter("key = 'next_id'").first()["value"]
        fresh = rescan_event(wanted, now_ms).withColumn("id", F.monotonically_increasing_id() + next_id)
        old = now.table("events")
        fresh = fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns]).checkpoint()
        top = fresh.agg(F.coalesce(F.max("id") + 1, F.lit(next_id))).first()[0]
        return {
            "sessions": patch(now.table("sessions"), changes, "scan_id", columns), "events": old.unionByName(fresh),
            "counters": upsert(now.table("counters"), counter(store.spark, top), "key"),
        }

    checkpoints(store.spark)
    retried(store, change, notes={"batch": str(batch), "before_batch": str(start.version)})
    return failed


def rescan_stream(store: Store, messages: DataFrame, rescan: Callable[[DataFrame], DataFrame], retry_path: str, dlq_path: str, checkpoint: str, now_ms: Callable[[], int], most: int = 3):
    """Dequeue, rescan, apply, and route failures: each batch of a stream of messages; `rescan` gives the scans (scan_id) that it could do."""
    def take(batch: DataFrame, batch_id: int) -> None:
        failed = rescans_processed(store, batch, rescan(batch), now_ms(), batch_id, most)
        for route, path in (("retry", retry_path), ("dlq", dlq_path)):
            failed.filter(F.col("route") == route).drop("route").write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return messages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
