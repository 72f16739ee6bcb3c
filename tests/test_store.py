"""Versions of several tables: whole or not at all."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from kindred.operators import session_store as ops
from kindred.sources.store import Conflict, Store
from kindred.streaming import Cancelled, cancellable, flag_file


def rows(spark, ids, status="proposed", at=0):
    return spark.createDataFrame([(f"s{i}", status, 1000 + i + at) for i in ids], "scan_id string, status string, updated_at_ms long")


def logs(spark, ids, per=2):
    return spark.createDataFrame([(i * 10 + k, f"s{i}", f"a{k}") for i in ids for k in range(per)], "id long, scan_id string, action string")


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, f"file://{tmp_path}/store")
    assert ops.replace_all(out, rows(spark, range(6)), logs(spark, range(6)), 7) == 1
    return out


def state(snapshot):
    return sorted(map(tuple, snapshot.table("sessions").select("scan_id", "status", "updated_at_ms").collect())), sorted(map(tuple, snapshot.table("events").select("id", "scan_id", "action").collect())), snapshot.table("counters").first()["value"]


def test_changes_are_versions_of_both_tables(spark, store):
    first = store.snapshot()
    before = state(first)
    assert ops.save(store, rows(spark, [2, 9], "failed"), logs(spark, [2, 9], 1), 10) == 2
    now = state(store.snapshot())
    assert [s[0] for s in now[0]] == ["s0", "s1", "s2", "s3", "s4", "s5", "s9"] and now[0][2][1] == "failed" and [e[0] for e in now[1] if e[1] == "s2"] == [20] and now[2] == 10
    assert state(first) == before  # a reader keeps its version
    ops.update(store, rows(spark, [0], "tracking"), ["status"], logs(spark, [0], 3))
    ops.delete(store, rows(spark, [1, 9]))
    now = state(store.snapshot())
    assert [s[0] for s in now[0]] == ["s0", "s2", "s3", "s4", "s5"] and now[0][0][1:] == ("tracking", 1000) and len([e for e in now[1] if e[1] == "s0"]) == 3 and not [e for e in now[1] if e[1] in ("s1", "s9")]
    legacy = rows(spark, [3, 8], "completed", at=5).drop("status").withColumn("video", F.lit("v"))
    assert ops.import_legacy(store, legacy) == 5 and ops.import_legacy(store, legacy) == 5
    assert {s[0]: s[2] for s in state(store.snapshot())[0]} == {"s0": 1000, "s2": 1002, "s3": 1008, "s4": 1004, "s5": 1005, "s8": 1013}


def test_a_failure_between_the_tables_leaves_the_old_version(spark, store):
    before = state(store.snapshot())
    bad = logs(spark, range(3)).withColumn("action", F.when(F.col("id") == 21, F.raise_error(F.lit("no"))).otherwise(F.col("action")))
    with pytest.raises(Exception):
        ops.replace_all(store, rows(spark, range(3)), bad, 99)
    assert store.versions() == [1] and state(store.snapshot()) == before
    assert store.vacuum(least_age_s=0.0) > 0 and state(store.snapshot()) == before
    assert ops.replace_all(store, rows(spark, range(3)), logs(spark, range(3)), 99) == 2


def test_two_commits_from_one_version(spark, store):
    base = store.snapshot()
    assert store.commit({"sessions": rows(spark, [1])}, base) == 2
    with pytest.raises(Conflict):
        store.commit({"sessions": rows(spark, [2])}, base)
    assert [s[0] for s in state(store.snapshot())[0]] == ["s1"] and len(state(store.snapshot())[1]) == 12
    # a change that lost is made again on what the other left
    seen = []

    def change(now):
        seen.append(now.version)
        if len(seen) == 1:
            store.commit({"sessions": rows(spark, [4, 5])}, now)
        return {"sessions": now.table("sessions").withColumn("status", F.lit("failed"))}

    assert ops.retried(store, change) == 4 and seen == [2, 3]
    assert [s[:2] for s in state(store.snapshot())[0]] == [("s4", "failed"), ("s5", "failed")]
    assert store.vacuum(keep=1, least_age_s=0.0) > 0 and store.versions() == [4] and len(state(store.snapshot())[0]) == 2


def test_pages_open_few_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/pages")
    events = spark.range(5000).select("id", F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("scan_id"), (F.col("id") % 500).alias("updated_at_ms"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        store.commit({"events": events, "sessions": events}, keys={"events": ["id"], "sessions": ["updated_at_ms", "id"]})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    now, cursor, got = store.snapshot(), None, []
    total = len(now.table("events").inputFiles())
    assert total >= 15
    while True:
        page = now.page("events", 300, cursor)
        ids = [r.id for r in page.collect()]
        assert len(page.inputFiles()) <= 4 or not ids
        got += ids
        if not ids:
            break
        cursor = (ids[-1],)
    assert got == list(range(4999, -1, -1))
    want = sorted(((r.updated_at_ms, r.id) for r in events.collect()), reverse=True)
    at = want.index((250, 3750))
    page = now.page("sessions", 40, (250, 3750))
    assert [(r.updated_at_ms, r.id) for r in page.collect()] == want[at + 1 : at + 41] and len(page.inputFiles()) <= 3


def test_a_cancelled_job_leaves_no_version(spark, store, tmp_path):
    def slow(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    flag, began = tmp_path / "stop", []
    threading.Timer(4.0, lambda: (began.append(time.monotonic()), flag.write_text(""))).start()
    with pytest.raises(Cancelled):
        cancellable(spark, lambda: ops.replace_all(store, rows(spark, [1]), logs(spark, [1]).mapInArrow(slow, "id long, scan_id string, action string"), 5), flag_file(spark, f"file://{flag}"))
    assert time.monotonic() - began[0] < 6 and not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert store.versions() == [1] and len(state(store.snapshot())[0]) == 6
    assert cancellable(spark, lambda: ops.replace_all(store, rows(spark, [1]), logs(spark, [1]), 5), lambda: False) == 2
    with pytest.raises(ZeroDivisionError):
        cancellable(spark, lambda: 1 // 0, lambda: False)


def test_rescans_from_the_queue_to_the_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/jobs")
    sessions = spark.createDataFrame([(f"s{i}", st, True, 5, 100) for i, st in enumerate(["validated", "tracking", "failed", "completed"])], "scan_id string, status string, review_ready boolean, selected_identity_id long, updated_at_ms long")
    ops.replace_all(store, sessions, logs(spark, range(4)), 50)
    schema = "queue string, seq long, message_type string, job_id string, idempotency_key string, created_at_ms long, attempt long, scan_id string"
    for k, part in enumerate(([("rescan", i, "rescan", f"j{i}", f"k{i}", 1, i % 3, f"s{i}") for i in range(3)], [("rescan", 9, "rescan", "j9", "k9", 1, 0, "s3"), ("rescan", 10, "rescan", "j10", "k10", 1, 2, "nobody")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    can = lambda batch: batch.filter("scan_id <> 's1'").select("scan_id")
    ops.rescan_stream(store, source, can, f"{tmp_path}/retry", f"{tmp_path}/dlq", f"{tmp_path}/cp", lambda: 777).awaitTermination()
    now = store.snapshot()
    got = {r.scan_id: (r.status, r.review_ready, r.updated_at_ms) for r in now.table("sessions").collect()}
    assert got == {"s0": ("proposed", False, 777), "s1": ("tracking", True, 100), "s2": ("proposed", False, 777), "s3": ("completed", False, 777)}
    said = [r.scan_id for r in now.table("events").filter("action = 'split_rescan_processed'").collect()]
    assert sorted(said) == ["s0", "s2", "s3"] and now.table("events").count() == 11 and now.table("events").select("id").distinct().count() == 11
    assert [(r.job_id, r.attempt) for r in spark.read.json(f"{tmp_path}/retry").collect()] == [("j1", 2)] and [r.job_id for r in spark.read.json(f"{tmp_path}/dlq").collect()] == ["j10"]
    # the last batch comes again: nothing changes, and it fails the same messages
    batch = spark.read.schema(schema).json(f"{tmp_path}/in/1")
    assert [r.job_id for r in ops.rescans_processed(store, batch, can(batch), 999, 1).collect()] == ["j10"] and store.snapshot().version == now.version
