"""Streams give what batches give, also over several batches."""

import threading

from pyspark.sql import functions as F

from kindred import streaming
from kindred.operators import queues, tracking
from kindred.plans.ordered import _track_frames
from kindred.sources import messages, queue_stream


def test_dedupe_and_routes(spark, data, tmp_path):
    rows = messages(spark, data).limit(400)
    for k in range(3):  # three files, one batch each
        rows.filter(F.col("seq") % 3 == k).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = queue_stream(spark, str(tmp_path / "in"))
    for keep, name in ((None, "ever"), ("3650 days", "bounded")):
        query = streaming.accepted_stream(source, keep).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(name).count() == rows.select("idempotency_key").distinct().count()
    streaming.routed_stream(source, str(tmp_path / "retry"), str(tmp_path / "dlq"), str(tmp_path / "cp")).awaitTermination()
    want = queues.after_failure(rows).groupBy("route").count().collect()
    assert {r.route: spark.read.json(str(tmp_path / r.route)).count() for r in want} == {r.route: r["count"] for r in want}


def test_tracker_over_batches(spark, data, tmp_path):
    rows = _track_frames(spark, data).filter("frame_index < 900").select("track_id", "frame_index", "seen", "persons").persist()
    for k, part in enumerate(("frame_index % 400 < 150", "frame_index % 400 >= 150")):
        rows.filter(part).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    streaming.track_stream(source).writeStream.format("memory").queryName("tracks").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r.track_id, r.frame_index, r.state, r.source, r.miss_count) for r in df.collect())
    assert key(spark.table("tracks").fillna("-")) == key(tracking.track(rows).fillna("-"))
    rows.unpersist()


def test_drain_listen_and_maintain(spark, data, tmp_path):
    messages(spark, data).limit(50).coalesce(1).write.json(str(tmp_path / "in"))
    took, told = [], []
    listener = streaming.listen(spark, lambda name, n: told.append(n))
    streaming.drain(queue_stream(spark, str(tmp_path / "in")), lambda batch, k: took.append(batch.count()), str(tmp_path / "cp")).awaitTermination()
    spark.streams.removeListener(listener)
    assert sum(took) == 50

    def fails():
        raise RuntimeError("no")

    assert streaming.maintain(fails, threading.Event(), runs=1) == {"runs": 1, "last_error": "no"}
    stopped = threading.Event()
    stopped.set()
    assert streaming.maintain(fails, stopped)["runs"] == 0
