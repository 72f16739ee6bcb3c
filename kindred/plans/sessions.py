"""Queries of the session store and of retention."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..cluster import shared_folder
from ..functions.rules import known_status, mode_of
from ..operators import session_store as stored
from ..operators import sessions as ops
from ..sources import candidates, events, legacy_store, sessions
from ..sources.store import Store
from ._views import Plans

P = Plans()
NOW = 1_706_600_000_000  # 2024-01-30, within the events' month
PAGE = ops.Page.of(25)


@P.add("jn1_session_page", """SELECT s.scan_id, s.status, s.video, s.updated_at_ms, s.review_ready, s.expected_count, coalesce(c.n, 0)::BIGINT AS event_count
  FROM ses s LEFT JOIN (SELECT scan_id, count(*) AS n FROM ev GROUP BY scan_id) c USING (scan_id) WHERE s.status = 'validated' ORDER BY s.updated_at_ms DESC, s.scan_id DESC LIMIT 25""")
def _(spark, d):
    rows = ops.with_event_counts(ops.by_status(sessions(spark, d), " Validated "), events(spark, d))
    return ops.session_page(rows.select("scan_id", "status", "video", "updated_at_ms", "review_ready", "expected_count", "event_count"), PAGE)


@P.add("agg1_events_per_session", "SELECT scan_id, count(*)::BIGINT AS event_count FROM ev GROUP BY scan_id")
def _(spark, d):
    return events(spark, d).groupBy("scan_id").agg(F.count("*").alias("event_count"))


@P.add("agg2_store_counts", "SELECT (SELECT count(*) FROM ses)::BIGINT AS sessions, (SELECT count(*) FROM ev)::BIGINT AS events")
def _(spark, d):
    return ops.beside(sessions(spark, d).agg(F.count("*").alias("sessions")), events(spark, d).agg(F.count("*").alias("events")))


@P.add("fil1_status", "SELECT scan_id, status FROM ses WHERE status = 'tracking'")
def _(spark, d):
    return ops.by_status(sessions(spark, d), "  TRACKING").select("scan_id", "status")


@P.add("fil2_optional_parameters", "SELECT id, scan_id, at_ms FROM ev WHERE scan_id = 'scan-7'")
def _(spark, d):
    return events(spark, d).filter(ops.event_filter(scan_id="scan-7")).select("id", "scan_id", "at_ms")


@P.add("fil3_action_contains", "SELECT id, action FROM ev WHERE action ILIKE '%LI_K%'")
def _(spark, d):
    return events(spark, d).filter(ops.event_filter(action="LI_K")).select("id", "action")


@P.add("fil4_time_range", "SELECT id, at_ms FROM ev WHERE at_ms >= 1704500000000 AND at_ms <= 1705500000000")
def _(spark, d):
    return events(spark, d).filter(ops.event_filter(since=1_704_500_000_000, until=1_705_500_000_000)).select("id", "at_ms")


@P.add("fil5_expired", f"SELECT scan_id, updated_at_ms FROM ses WHERE updated_at_ms < {NOW} - 43200000")
def _(spark, d):
    return ops.expired(sessions(spark, d), NOW, 43_200_000).select("scan_id", "updated_at_ms")


@P.add("prj1_summary", "SELECT scan_id, video, status, updated_at_ms FROM ses")
def _(spark, d):
    return sessions(spark, d).select("scan_id", "video", "status", "updated_at_ms")


@P.add("prj2_without_embedding", "SELECT id, scan_id, round(confidence, 6) AS confidence, NULL::DOUBLE AS embedding FROM cand")
def _(spark, d):
    return candidates(spark, d).select("id", "scan_id", F.round("confidence", 6).alias("confidence"), F.lit(None).cast("double").alias("embedding"))


@P.add("prj3_json_round_trip", "SELECT id, scan_id, id * 2 AS pair_sum, 3::BIGINT AS n_ids FROM ev")
def _(spark, d):
    stored = events(spark, d).select("id", "scan_id", F.to_json(F.struct(F.array(F.col("id"), F.col("id") + 1, F.lit(5)).alias("ids"), F.struct(F.col("id").alias("a"), F.col("id").alias("b")).alias("pair"))).alias("j"))
    back = stored.withColumn("o", F.from_json("j", "ids array<bigint>, pair struct<a:bigint,b:bigint>"))
    return back.select("id", "scan_id", (F.col("o.pair.a") + F.col("o.pair.b")).alias("pair_sum"), F.size("o.ids").cast("long").alias("n_ids"))


@P.add("prj4_status_text", """SELECT action, CASE WHEN action IN ('proposed','validated','tracking','completed','failed') THEN action ELSE 'proposed' END AS status, count(*)::BIGINT AS n
  FROM (SELECT action FROM ev UNION ALL SELECT status FROM ses) GROUP BY 1, 2""")
def _(spark, d):
    text = events(spark, d).select("action").unionByName(sessions(spark, d).select(F.col("status").alias("action")))
    return text.groupBy("action", known_status(F.col("action")).alias("status")).agg(F.count("*").alias("n"))


@P.add("prj5_mode", """SELECT m AS given, CASE WHEN lower(trim(m)) IN ('quality','hq') THEN 'quality' WHEN lower(trim(m)) IN ('balanced','balance','normal') THEN 'balanced' ELSE 'fast' END AS mode, count(*)::BIGINT AS n
  FROM (SELECT [' HQ', 'Normal ', 'quality', 'turbo', 'balance'][(id % 5 + 1)::INT] AS m FROM ev) GROUP BY 1, 2""")
def _(spark, d):
    given = F.element_at(F.array(*[F.lit(m) for m in (" HQ", "Normal ", "quality", "turbo", "balance")]), (F.col("id") % 5 + 1).cast("int"))
    rows = events(spark, d).select(given.alias("given"))
    return rows.groupBy("given", mode_of(F.col("given")).alias("mode")).agg(F.count("*").alias("n"))


@P.add("prj6_coalesced", "SELECT scan_id, coalesce(CASE WHEN user_id % 4 = 0 THEN 9::BIGINT END, expected_count) AS expected_count FROM ses")
def _(spark, d):
    return sessions(spark, d).select("scan_id", F.coalesce(F.when(F.col("user_id") % 4 == 0, F.lit(9).cast("long")), F.col("expected_count")).alias("expected_count"))


@P.add("src6_event_scan", "SELECT id, scan_id, at_ms, action, details FROM ev ORDER BY at_ms, id")
def _(spark, d):
    return events(spark, d).select("id", "scan_id", "at_ms", "action", "details").orderBy("at_ms", "id")


@P.add("src7_point_lookup", "SELECT 'next_id' AS key, max(id) + 1 AS value FROM ev")
def _(spark, d):
    state = events(spark, d).agg((F.max("id") + 1).alias("value")).select(F.lit("next_id").alias("key"), "value")
    return state.filter(F.col("key") == "next_id").limit(1)


@P.add("jn2_sessions_with_events", """SELECT s.scan_id, count(e.id)::BIGINT AS n, coalesce(string_agg(e.action, ',' ORDER BY e.at_ms, e.id), '') AS actions
  FROM ses s LEFT JOIN ev e USING (scan_id) GROUP BY s.scan_id""")
def _(spark, d):
    rows = ops.with_events(sessions(spark, d), events(spark, d))
    return rows.select("scan_id", F.size("events").cast("long").alias("n"), F.array_join(F.transform("events", lambda e: e["action"]), ",").alias("actions"))


@P.add("jn3_ranked_delete", """SELECT id, scan_id FROM ev WHERE id NOT IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY scan_id ORDER BY at_ms DESC, id DESC) AS rn FROM ev) WHERE rn > 20)""")
def _(spark, d):
    return ops.newest(events(spark, d), 20).select("id", "scan_id")


@P.add("win1_newest_per_session", """SELECT id, scan_id, rn FROM (SELECT id, scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY at_ms DESC, id DESC)::INT AS rn FROM ev) WHERE rn <= 10""")
def _(spark, d):
    return ops.newest(events(spark, d), 10).select("id", "scan_id", "rn")


@P.add("win7_bounded_log", """SELECT scan_id, count(*)::BIGINT AS kept, min(id) AS oldest FROM (SELECT id, scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY at_ms DESC, id DESC) AS rn FROM ev) WHERE rn <= 40 GROUP BY scan_id""")
def _(spark, d):
    return ops.newest(events(spark, d), 40).groupBy("scan_id").agg(F.count("*").alias("kept"), F.min("id").alias("oldest"))


@P.add("win8_recent_first", "SELECT id, scan_id, at_ms FROM ev WHERE scan_id = 'scan-3' ORDER BY at_ms DESC, id DESC LIMIT 25")
def _(spark, d):
    return events(spark, d).filter("scan_id = 'scan-3'").orderBy(F.desc("at_ms"), F.desc("id")).limit(25).select("id", "scan_id", "at_ms")


@P.add("srt1_offset_page", "SELECT scan_id, updated_at_ms FROM ses ORDER BY updated_at_ms DESC, scan_id DESC LIMIT 20 OFFSET 40")
def _(spark, d):
    return ops.session_page(sessions(spark, d).select("scan_id", "updated_at_ms"), ops.Page.of(20, 40))


@P.add("srt2_keyset_page", """WITH c AS (SELECT updated_at_ms AS t, scan_id AS k FROM ses ORDER BY updated_at_ms DESC, scan_id DESC LIMIT 1 OFFSET 19)
  SELECT scan_id, updated_at_ms FROM ses, c WHERE updated_at_ms < t OR (updated_at_ms = t AND scan_id < k) ORDER BY updated_at_ms DESC, scan_id DESC LIMIT 20""")
def _(spark, d):
    rows = sessions(spark, d).select("scan_id", "updated_at_ms")
    last = ops.next_cursor(ops.session_page(rows, ops.Page.of(20)).collect(), "updated_at_ms", "scan_id")  # one page of rows
    return ops.session_page(rows, ops.Page.of(20, cursor=last))


@P.add("srt3_event_keyset", "SELECT id, scan_id FROM ev WHERE id < 500 ORDER BY id DESC LIMIT 40")
def _(spark, d):
    return ops.event_page(events(spark, d).select("id", "scan_id"), ops.Page.of(40, 99, (500,)))


_LEFT = f"WITH o AS (SELECT scan_id FROM ses WHERE updated_at_ms < {NOW} - 43200000), l AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY at_ms DESC, id DESC) AS rn FROM ev WHERE scan_id NOT IN (SELECT scan_id FROM o))"


@P.add("srt4_page_rules", """SELECT id, CASE WHEN id % 7 = 0 THEN 25 ELSE least(greatest(id % 400 - 50, 1), 200) END::BIGINT AS page_limit, CASE WHEN id % 3 > 0 AND id % 4 > 0 OR id % 5 = 0 THEN 0 ELSE id % 90 END::BIGINT AS page_offset,
  id % 3 > 0 AND id % 4 > 0 AND id % 5 > 0 AND id % 90 > 0 AS offset_ignored FROM ev""")
def _(spark, d):
    n = F.col("id")
    unless = lambda k, value: F.when(n % k > 0, value)
    rules = ops.page_rules(unless(7, n % 400 - 50), unless(5, n % 90), unless(3, F.col("at_ms")), unless(4, F.col("scan_id")))
    return events(spark, d).select("id", *[c.cast(kind).alias(name) for c, kind, name in zip(rules, ("long", "long", "boolean"), ("page_limit", "page_offset", "offset_ignored"))])


@P.add("str3_maintenance_store", _LEFT + " SELECT scan_id, count(*)::BIGINT AS events, 2::BIGINT AS runs FROM l WHERE rn <= 30 GROUP BY scan_id")
def _(spark, d):
    store = _store(spark, d)
    old = events(spark, d).select("id", "scan_id", "at_ms")
    stored.replace_all(store, sessions(spark, d).select("scan_id", "updated_at_ms"), old, 1)
    for _ in range(2):  # the second run finds nothing left to do
        stored.maintained(store, NOW, 43_200_000, 30)
    now = store.snapshot()
    return now.table("events").groupBy("scan_id").agg(F.count("*").alias("events")).withColumn("runs", F.lit(int(now.notes["maintenance_runs"])).cast("long"))


@P.add("srt13_list_sessions", "SELECT scan_id, status, updated_at_ms FROM ses ORDER BY updated_at_ms DESC, scan_id DESC")
def _(spark, d):
    return sessions(spark, d).select("scan_id", "status", "updated_at_ms").orderBy(F.desc("updated_at_ms"), F.desc("scan_id"))


@P.add("srt14_render_limit", "SELECT scan_id FROM ses ORDER BY updated_at_ms DESC, scan_id DESC LIMIT 48")
def _(spark, d):
    return sessions(spark, d).orderBy(F.desc("updated_at_ms"), F.desc("scan_id")).limit(24 + 24).select("scan_id")


@P.add("rev5_ttl_cleanup", f"SELECT scan_id FROM ses WHERE NOT updated_at_ms < {NOW} - 86400000")
def _(spark, d):
    rows = sessions(spark, d)
    return ops.without(rows, ops.expired(rows, NOW, 86_400_000)).select("scan_id")




@P.add("rev6_maintenance_events", _LEFT + " SELECT id, scan_id FROM l WHERE rn <= 30")
def _(spark, d):
    return ops.maintenance(sessions(spark, d), events(spark, d), NOW, 43_200_000, 30)["events"].select("id", "scan_id")


@P.add("rev6_maintenance_counts", _LEFT + " SELECT (SELECT count(*) FROM o)::BIGINT AS deleted_sessions, (SELECT count(*) FROM l WHERE rn > 30)::BIGINT AS deleted_events")
def _(spark, d):
    return ops.maintenance(sessions(spark, d), events(spark, d), NOW, 43_200_000, 30)["counts"]


def _changes(spark, d):
    return sessions(spark, d).filter("user_id % 10 = 3").withColumn("status", F.lit("failed")).withColumn("updated_at_ms", F.col("updated_at_ms") + 1)


def _store(spark, d) -> Store:
    """A store of its own with all sessions and events."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    stored.replace_all(store, sessions(spark, d).select("scan_id", "status", "video", "updated_at_ms"), events(spark, d).select("id", "scan_id", "action"), 1)
    return store


def _saved(spark, d):
    return events(spark, d).filter("user_id % 10 = 3 and id % 2 = 0").select("id", "scan_id", F.lit("saved").alias("action"))


@P.add("snk2_full_replace", "SELECT scan_id, 'failed' AS status, updated_at_ms + 1 AS updated_at_ms FROM ses WHERE user_id % 10 = 3")
def _(spark, d):
    store = _store(spark, d)
    stored.replace_all(store, _changes(spark, d).select("scan_id", "status", "updated_at_ms"), _saved(spark, d), 9)
    return store.snapshot().table("sessions")


@P.add("snk2_events_replaced", "SELECT id, scan_id, 'saved' AS action FROM ev WHERE user_id % 10 = 3 AND id % 2 = 0")
def _(spark, d):
    store = _store(spark, d)
    stored.replace_all(store, _changes(spark, d).select("scan_id", "status", "updated_at_ms"), _saved(spark, d), 9)
    return store.snapshot().table("events")


@P.add("snk3_store", """SELECT id, e.scan_id, action, status FROM (SELECT id, scan_id, action FROM ev WHERE user_id % 10 <> 3 UNION ALL SELECT id, scan_id, 'saved' FROM ev WHERE user_id % 10 = 3 AND id % 2 = 0) e
  JOIN (SELECT scan_id, CASE WHEN user_id % 10 = 3 THEN 'failed' ELSE status END AS status FROM ses) USING (scan_id)""")
def _(spark, d):
    store = _store(spark, d)
    stored.save(store, _changes(spark, d).select("scan_id", "status", "video", "updated_at_ms"), _saved(spark, d), 2)
    now = store.snapshot()
    return now.table("events").join(now.table("sessions"), "scan_id").select("id", "scan_id", "action", "status")


@P.add("snk5_store", "SELECT scan_id, n FROM (SELECT scan_id FROM ses WHERE user_id % 10 <> 3) JOIN (SELECT scan_id, count(*)::BIGINT AS n FROM ev GROUP BY scan_id) USING (scan_id)")
def _(spark, d):
    store = _store(spark, d)
    stored.delete(store, _changes(spark, d))
    now = store.snapshot()
    counts = now.table("events").groupBy("scan_id").agg(F.count("*").alias("n"))
    return now.table("sessions").select("scan_id").join(counts, "scan_id", "full")


@P.add("srt2_store_page", "SELECT scan_id, updated_at_ms FROM ses WHERE (updated_at_ms, scan_id) < (SELECT (updated_at_ms, scan_id) FROM ses ORDER BY updated_at_ms DESC, scan_id DESC OFFSET 24 LIMIT 1) ORDER BY updated_at_ms DESC, scan_id DESC LIMIT 25")
def _(spark, d):
    now = _store(spark, d).snapshot()
    first = now.page("sessions", 25).collect()
    return now.page("sessions", 25, ops.next_cursor(first, "updated_at_ms", "scan_id")).select("scan_id", "updated_at_ms")


@P.add("srt3_store_page", "SELECT id, scan_id FROM ev WHERE id < (SELECT max(id) // 2 FROM ev) ORDER BY id DESC LIMIT 40")
def _(spark, d):
    now = _store(spark, d).snapshot()
    last = now.page("events", 1).first()["id"]
    return now.page("events", 40, (last // 2,)).select("id", "scan_id")


@P.add("snk3_upsert", "SELECT scan_id, CASE WHEN user_id % 10 = 3 THEN 'failed' ELSE status END AS status, updated_at_ms + (user_id % 10 = 3)::INT AS updated_at_ms FROM ses")
def _(spark, d):
    keep = ["scan_id", "status", "updated_at_ms"]
    return ops.upsert(sessions(spark, d).select(*keep), _changes(spark, d).select(*keep), "scan_id")


@P.add("snk3_events_replaced", """SELECT id, scan_id, action FROM ev WHERE user_id % 10 <> 3 UNION ALL SELECT id, scan_id, 'saved' FROM ev WHERE user_id % 10 = 3 AND id % 2 = 0""")
def _(spark, d):
    old = events(spark, d)
    new = old.filter("user_id % 10 = 3 and id % 2 = 0").withColumn("action", F.lit("saved"))
    return ops.replace_events(old, new, _changes(spark, d)).select("id", "scan_id", "action")


@P.add("snk4_patch", "SELECT scan_id, CASE WHEN user_id % 10 = 3 THEN 'failed' ELSE status END AS status, video FROM ses")
def _(spark, d):
    return ops.patch(sessions(spark, d).select("scan_id", "status", "video"), _changes(spark, d), "scan_id", ["status"])


@P.add("snk5_cascade_delete", "SELECT id, scan_id FROM ev WHERE user_id % 10 <> 3")
def _(spark, d):
    return ops.without(events(spark, d), _changes(spark, d)).select("id", "scan_id")


@P.add("snk6_counter", "SELECT 'next_id' AS key, max(id) + 1 AS value FROM ev")
def _(spark, d):
    old = spark.createDataFrame([("next_id", 1)], "key string, value long")
    return ops.upsert(old, events(spark, d).agg((F.max("id") + 1).alias("value")).select(F.lit("next_id").alias("key"), "value"), "key")


@P.add("snk13_sequence_ids", "SELECT id, 'run-' || at_ms || '-' || row_number() OVER (PARTITION BY scan_id ORDER BY at_ms, id) AS run_id FROM ev")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("scan_id").orderBy("at_ms", "id"))
    return events(spark, d).select("id", F.concat_ws("-", F.lit("run"), F.col("at_ms").cast("string"), n.cast("string")).alias("run_id"))


@P.add("src8_legacy_store", """SELECT scan_id, status, expected_count, updated_at_ms, user_id::BIGINT AS a, user_id::BIGINT + 1 AS b, CASE WHEN user_id % 2 = 0 THEN user_id ELSE user_id + 1 END::BIGINT AS keep FROM ses""")
def _(spark, d):
    a, b = F.col("user_id").cast("long"), F.col("user_id").cast("long") + 1
    pairs = F.when(F.col("user_id") % 2 == 0, F.to_json(F.array(F.array(a, b)))).otherwise(F.to_json(F.array(F.struct(a.alias("a"), b.alias("b"), b.alias("keep")))))
    top = f"{shared_folder(spark)}/legacy-{uuid.uuid4().hex}"
    sessions(spark, d).select("scan_id", "video", "status", "expected_count", "updated_at_ms", pairs.alias("resolved_duplicates")).write.json(top)
    return legacy_store(spark, top).select("scan_id", "status", "expected_count", "updated_at_ms", F.inline("resolved_duplicates"))


@P.add("snk14_import_rewrite", """SELECT scan_id, max(updated_at_ms) AS updated_at_ms, bool_or(own) AS stored FROM (SELECT scan_id, updated_at_ms, true AS own FROM ses WHERE user_id % 3 > 0
  UNION ALL SELECT scan_id, updated_at_ms + (CASE WHEN user_id % 4 = 0 THEN 5 ELSE -5 END), false FROM ses WHERE user_id % 2 = 0) GROUP BY scan_id""")
def _(spark, d):
    rows = sessions(spark, d)
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    stored.replace_all(store, rows.filter("user_id % 3 > 0").select("scan_id", "status", "video", "updated_at_ms"), events(spark, d).select("id", "scan_id", "action"), 1)
    before = store.snapshot()
    top = f"{shared_folder(spark)}/legacy-{uuid.uuid4().hex}"
    at = F.col("updated_at_ms") + F.when(F.col("user_id") % 4 == 0, 5).otherwise(-5)
    rows.filter("user_id % 2 = 0").select("scan_id", "video", "status", "expected_count", at.alias("updated_at_ms"), F.lit("[]").alias("resolved_duplicates")).write.json(top)
    stored.import_legacy(store, legacy_store(spark, top))
    old = before.table("sessions").select("scan_id", F.lit(True).alias("stored"))
    return store.snapshot().table("sessions").join(old, "scan_id", "left").select("scan_id", "updated_at_ms", F.coalesce("stored", F.lit(False)).alias("stored"))


@P.add("set4_page_append", "SELECT id FROM ev WHERE id < 100 UNION ALL SELECT id FROM ev WHERE id < 50")
def _(spark, d):
    rows = events(spark, d).select("id")
    return rows.filter("id < 100").unionByName(rows.filter("id < 50"))


@P.add("str6_latest_reply", "SELECT scan_id, action, id FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY id DESC) AS rn FROM ev) WHERE rn = 1")
def _(spark, d):
    return ops.latest(events(spark, d), "scan_id", "id").select("scan_id", "action", "id")
