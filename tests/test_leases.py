"""Leases and throttled progress as streams, against their batch forms."""

import random

from pyspark.sql import functions as F

from kindred.operators import ordered
from kindred.streaming.leases import lease_outcomes, leased_stream, throttled_stream

LEASES = "message_id string, kind string, at_ms long, receipt int, attempt int, body string"


def written(spark, rows, schema, path, parts):
    """The rows as one file for each of `parts`, in order of time."""
    rows = sorted(rows, key=lambda r: r[2])
    for k, part in enumerate(parts):
        spark.createDataFrame([r for r in rows if part(r)], schema).coalesce(1).write.mode("append").json(f"{path}/{k:02d}")


def run(spark, stream, tmp_path, name):
    """All files, one a batch, over two runs of the query: the second goes on from the first one's checkpoint."""
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_a_worker_that_dies_loses_no_message(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        sent = [(f"m{i}", "sent", 1000 + i, None, i % 3, f"body {i}") for i in range(12)]
        replies = [("m0", "ack", 5000, 1, None, None), ("m3", "ack", 40_000, 1, None, None), ("m3", "ack", 41_000, 2, None, None), ("m6", "fail", 2000, 1, None, None), ("m6", "ack", 3000, 2, None, None),
                   ("m9", "fail", 2000, 1, None, None), ("m9", "fail", 2500, 2, None, None), ("m9", "ack", 2600, 2, None, None), ("m1", "ack", 31_001, 1, None, None), ("m2", "fail", 1500, 1, None, None)]
        ticks = [(f"tick{k}", "sent", 10**6 * (k + 1), None, 0, None) for k in range(5)]
        rows = sent + replies + ticks
        path = str(tmp_path / "in")
        written(spark, rows, LEASES, path, [lambda r: r[2] < 2000, lambda r: 2000 <= r[2] < 30_000, lambda r: 30_000 <= r[2] < 10**6, *[lambda r, k=k: r[2] == 10**6 * (k + 1) for k in range(5)]])
        source = spark.readStream.schema(LEASES).option("maxFilesPerTrigger", 1).json(path + "/*")
        out = run(spark, leased_stream(source, watermark="0 seconds"), tmp_path, "leases").filter("message_id not like 'tick%'")
        found = {m: [(r.kind, r.receipt, r.attempt, r.at_ms) for r in sorted((r for r in out.collect() if r.message_id == m), key=lambda r: (r.at_ms, r.receipt, r.kind == "delivered"))] for m in (f"m{i}" for i in range(12))}
        assert found["m0"] == [("delivered", 1, 0, 1000), ("done", 1, 0, 5000)]
        assert found["m3"] == [("delivered", 1, 0, 1003), ("delivered", 2, 1, 31_003), ("done", 2, 1, 41_000)]  # too late, then in time
        assert [x[0] for x in found["m6"]] == ["delivered", "delivered", "done"] and [x[0] for x in found["m9"]] == ["delivered", "delivered", "delivered", "dlq"]
        assert found["m4"] == [("delivered", 1, 1, 1004), ("delivered", 2, 2, 31_004), ("dlq", 2, 2, 61_004)] and found["m2"][-1][0] == "dlq"
        messages = spark.createDataFrame([(m, at, a) for m, _, at, _, a, _ in sent], "message_id string, at_ms long, attempt int")
        answers = spark.createDataFrame([(m, r, k, at) for m, k, at, r, *_ in replies], "message_id string, receipt int, kind string, at_ms long")
        batch = {r.message_id: (r.outcome, r.deliveries, r.at_ms) for r in lease_outcomes(messages, answers).collect()}
        assert batch == {m: (x[-1][0], x[-1][1], x[-1][3]) for m, x in found.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_throttled_progress_is_that_of_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rng, rows, at = random.Random(1), [], 0
        for i in range(400):
            at += rng.choice([0, 10, 60, 200])
            rows.append((rng.choice(["a", "b", "c"]), i, at, float(i)))
        ticks = [(f"tick{k}", 1000 + k, at + 10**7 * (k + 1), 0.0) for k in range(2)]
        schema = "key string, seq long, at_ms long, value double"
        path = str(tmp_path / "in")
        written(spark, rows + ticks, schema, path, [*[lambda r, k=k: r[1] < 1000 and r[1] // 100 == k for k in range(4)], lambda r: r[1] == 1000, lambda r: r[1] == 1001])
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path + "/*")
        out = run(spark, throttled_stream(source, 180, 100_000, "0 seconds"), tmp_path, "throttle").filter("key not like 'tick%'")
        got = {r.key: r.n for r in out.groupBy("key").agg(F.count("*").alias("n")).collect()}
        want = {r.key: r.emitted for r in ordered.throttled(spark.createDataFrame(rows, schema), "key", "at_ms", ["at_ms", "seq"], 180).collect()}
        assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
