"""Views of the raw tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUSES = ("proposed", "validated", "tracking", "completed", "failed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events: id, scan_id, at_ms, action, details; user_id and value for the derived shapes."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("scan-"), F.col("user_id").cast("string")).alias("scan_id"),
        epoch_ms("ts").alias("at_ms"), F.col("event_type").alias("action"), F.col("props").alias("details"), "user_id", "value",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per user, last updated at its last event."""
    user = F.col("user_id")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (user % 5 + 1).cast("int"))
    return (
        table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(epoch_ms("ts")).alias("updated_at_ms"))
        .select(
            F.concat(F.lit("scan-"), user.cast("string")).alias("scan_id"), F.concat(F.lit("video-"), (user % 9).cast("string"), F.lit(".mp4")).alias("video"),
            status.alias("status"), F.when(user % 3 != 0, user % 7).alias("expected_count"), (user % 2 == 0).alias("review_ready"), "updated_at_ms", "user_id",
        )
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections per frame: frame_index, box_id, x1, y1, x2, y2, confidence."""
    of_frame = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x1, y1 = (F.col("l_partkey") * 7 % 120).cast("double"), (F.col("l_suppkey") * 13 % 120).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_index"), F.row_number().over(of_frame).alias("box_id"), x1.alias("x1"), y1.alias("y1"),
        (x1 + 80 + F.col("l_quantity")).alias("x2"), (y1 + 120 + F.col("l_quantity") * 2).alias("y2"),
        (F.col("l_extendedprice") / (F.col("l_extendedprice") + 50000)).alias("confidence"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with the scores that recognition adds."""
    part = F.col("frame_index") * 31 + F.col("box_id") * 17
    return boxes(spark, sf_dir).withColumns({
        "similarity": (part % 97) / 97.0, "margin": (part * 7 % 89) / 178.0, "impostor_similarity": (part % 97) / 97.0 - (part * 7 % 89) / 178.0,
        "body_similarity": F.when(part % 4 != 0, (part % 83) / 41.5 - 1.0),
    })


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order as a frame: frame_index, the frame's size, and a camera."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("frame_index"), F.when(key % 2 == 0, 1920).otherwise(1080).cast("long").alias("width"), F.when(key % 2 == 0, 1080).otherwise(1920).cast("long").alias("height"),
        F.when(key % 11 != 0, (key * 37 % 1900).cast("double")).alias("cx"), F.when(key % 11 != 0, (key * 53 % 1050).cast("double")).alias("cy"),
        (F.col("o_totalprice") % 700).alias("half_size"), F.element_at(F.array(*[F.lit(s) for s in ("observed", "predicted", "held")]), (key % 3 + 1).cast("int")).alias("source"),
        (key % 23).alias("miss_count"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity candidates of a scan per embedding label."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("id"), F.concat(F.lit("scan-"), F.col("label").cast("string")).alias("scan_id"), F.col("label").cast("long").alias("label"),
        ((v * 37 % 60) / 100.0 + 0.4).alias("confidence"), (v % 9 + 1).alias("observations"), (v * 3).alias("first_frame"), (v * 3 + v % 50).alias("last_frame"),
        ((v * 7 % 100) / 1000.0).alias("anchor_x"), ((v * 13 % 100) / 1000.0).alias("anchor_y"), ((v * 11 % 60) / 100.0 + 0.3).alias("face_presence"),
        ((v * 17 % 50) / 100.0 + 0.4).alias("thumbnail_score"), "embedding",
    )


def cluster_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in frame order for clustering, a scan per label."""
    return candidates(spark, sf_dir).select(
        "scan_id", F.col("id").alias("frame_index"), "anchor_x", "anchor_y", "confidence", "embedding", "face_presence", F.col("thumbnail_score").alias("quality")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue messages: queue, seq, message_type, job_id, idempotency_key, created_at_ms, attempt."""
    return events(spark, sf_dir).select(
        F.when(F.col("action").isin("error", "purchase"), "rescan").otherwise("discovery").alias("queue"), F.col("id").alias("seq"),
        F.col("action").alias("message_type"), F.concat(F.lit("job-"), F.col("id").cast("string")).alias("job_id"),
        F.concat_ws(":", F.col("user_id").cast("string"), "action").alias("idempotency_key"), F.col("at_ms").alias("created_at_ms"), (F.col("id") % 4).alias("attempt"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bundles with the digest that the manifest expects (null for some, wrong for some)."""
    key = F.col("doc_id")
    expected = F.when(key % 7 == 0, None).when(key % 5 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("diag-"), key.cast("string"), F.lit(".json")).alias("file_name"), F.concat(F.lit("/data/bundles/"), "source", F.lit("/diag-"), key.cast("string"), F.lit(".json")).alias("path"),
        F.octet_length("text").cast("long").alias("bytes"), (key * 7919 % 1000).alias("modified_at_ms"), expected.alias("sha256"), "text", "doc_id",
    )
