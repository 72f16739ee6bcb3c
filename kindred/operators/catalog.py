"""Artifact bundles: listing, pruning, verification, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sessions import beside


def newest_bundles(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first, ties by name descending; 1 to 500 rows, 30 by default."""
    n = min(max(30 if limit is None else limit, 1), 500)
    return rows.orderBy(F.desc("modified_at_ms"), F.desc("file_name")).limit(n)


def to_prune(rows: DataFrame, keep: int = 20, by: str = "source") -> DataFrame:
    """Bundles beyond the newest `keep` of each folder."""
    w = Window.partitionBy(by).orderBy(F.desc("modified_at_ms"), F.desc("file_name"))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") > keep)


def verified(content: Column, expected: Column) -> Column:
    """Whether the content has the expected digest; false without one."""
    return F.coalesce(F.sha2(content, 256) == expected, F.lit(False))


def head(content: Column, most: int = 256 * 1024) -> tuple[Column, Column]:
    """The first bytes of a content (1 KiB to 2 MiB) as text, and whether it was cut; what is no UTF-8 becomes U+FFFD."""
    n = min(max(most, 1024), 2 * 1024 * 1024)
    raw = content.cast("binary")
    return F.make_valid_utf8(F.substring(raw, 1, n).cast("string")), F.octet_length(raw) > n


def under(path: Column, folder: str) -> Column:
    """Whether a path lies in a folder, by whole components."""
    return path.startswith(folder.rstrip("/") + "/")


def manifest_upsert(manifest: DataFrame, new: DataFrame) -> DataFrame:
    return manifest.join(new.select("path"), "path", "left_anti").unionByName(new)


def manifest_remove(manifest: DataFrame, gone: DataFrame) -> DataFrame:
    return manifest.join(gone.select("path"), "path", "left_anti")


def with_expected(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    return rows.join(manifest.select("path", F.col("sha256").alias("expected_sha256")), "path", "left")


def carried_over(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Listed bundles with the verification state that an earlier listing had, if any."""
    return rows.join(states.select("path", "verify_state"), "path", "left")


def diagnostics(sessions: DataFrame, events: DataFrame, queues: DataFrame, n_sessions: int = 50, n_events: int = 80) -> DataFrame:
    """One JSON text with counts, the newest sessions and events (bounded by the report's size) and the queues."""
    counts = [sessions.agg(F.count("*").alias("sessions")), events.agg(F.count("*").alias("events"))]
    top = lambda rows, n, *order: rows.orderBy(*[F.desc(c) for c in order]).limit(n)
    s = top(sessions, n_sessions, "updated_at_ms", "scan_id").agg(F.array_sort(F.collect_list(F.struct("updated_at_ms", "scan_id", "status"))).alias("recent_sessions"))
    e = top(events, n_events, "at_ms", "id").agg(F.array_sort(F.collect_list(F.struct("at_ms", "id", "scan_id", "action"))).alias("recent_events"))
    q = queues.agg(F.array_sort(F.collect_list(F.struct("queue", "depth"))).alias("queues"))
    return beside(*counts, s, e, q).select(F.to_json(F.struct("*")).alias("report"))
