"""Queries over ordered rows: run lengths, folds, trackers, and review."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rules import guarded
from ..operators import ordered, review, tracking
from ..operators.detections import best_per_frame
from ..sources import boxes, candidates, events, observations, sessions, table
from ._views import Plans

P = Plans()
_SIM = "least(greatest(value / 100, 0::DOUBLE), 1::DOUBLE)"
_HIT = f"SELECT *, {_SIM} >= 0.1::DOUBLE AS hit FROM ev"


def r6(column, name):
    return F.round(column, 6).alias(name)


def _similarity():
    return F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))


def _runs(spark, d):
    return ordered.runs(events(spark, d), "scan_id", "id", _similarity() >= 0.1)


_RUN = """SELECT id, scan_id, hit, CASE WHEN hit THEN row_number() OVER (PARTITION BY scan_id, hit, misses ORDER BY id) ELSE 0 END AS hit_run,
  CASE WHEN NOT hit THEN row_number() OVER (PARTITION BY scan_id, hit, hits ORDER BY id) ELSE 0 END AS miss_run
  FROM (SELECT *, sum(hit::INT) OVER w AS hits, sum((NOT hit)::INT) OVER w AS misses FROM (""" + _HIT + ") WINDOW w AS (PARTITION BY scan_id ORDER BY id))"


@P.add("win5_miss_runs", f"SELECT id, scan_id, miss_run::BIGINT AS miss_run FROM ({_RUN})")
def _(spark, d):
    return _runs(spark, d).select("id", "scan_id", "miss_run")


@P.add("win6_hit_runs", f"SELECT id, scan_id, hit_run::BIGINT AS hit_run, hit_run >= 2 AS locks FROM ({_RUN})")
def _(spark, d):
    return _runs(spark, d).select("id", "scan_id", "hit_run", (F.col("hit_run") >= 2).alias("locks"))


@P.add("trk3_miss_policy", f"SELECT id, CASE WHEN miss_run = 0 THEN 'observed' WHEN miss_run <= 6 THEN 'predicted' WHEN miss_run <= 30 THEN 'held' END AS source FROM ({_RUN})")
def _(spark, d):
    return _runs(spark, d).select("id", ordered.miss_policy(F.col("miss_run")).alias("source"))


@P.add("win4_smoothed", f"SELECT scan_id, round(list_reduce(list_prepend(0.6::DOUBLE, list({_SIM} ORDER BY id)), lambda s, x: s * 0.85::DOUBLE + x * (1 - 0.85::DOUBLE)), 6) AS ema, count(*)::BIGINT AS n FROM ev GROUP BY scan_id")
def _(spark, d):
    out = ordered.smoothed(events(spark, d), "scan_id", ["id"], _similarity())
    return out.select("scan_id", r6(F.col("state"), "ema"), "n")


@P.add("win4_half_size", "SELECT scan_id, round(list_reduce(list_prepend(40::DOUBLE, list(value ORDER BY id)), lambda s, x: s * 0.88::DOUBLE + x * (1 - 0.88::DOUBLE)), 6) AS half_size FROM ev GROUP BY scan_id")
def _(spark, d):
    return ordered.smoothed(events(spark, d), "scan_id", ["id"], F.col("value"), 0.88, 40.0).select("scan_id", r6(F.col("state"), "half_size"))


@P.add("win4_running", f"""WITH RECURSIVE o AS (SELECT scan_id, id, {_SIM} AS x, row_number() OVER (PARTITION BY scan_id ORDER BY id) AS k FROM ev),
  f AS (SELECT scan_id, id, k, 0.6::DOUBLE * 0.85::DOUBLE + x * (1 - 0.85::DOUBLE) AS s FROM o WHERE k = 1 UNION ALL
    SELECT o.scan_id, o.id, o.k, f.s * 0.85::DOUBLE + o.x * (1 - 0.85::DOUBLE) FROM f JOIN o ON o.scan_id = f.scan_id AND o.k = f.k + 1)
  SELECT scan_id, id, round(s, 6) AS ema FROM f""")
def _(spark, d):
    return ordered.smoothed_rows(events(spark, d), "scan_id", ["id"], _similarity()).select("scan_id", "id", r6(F.col("state"), "ema"))


@P.add("agg11_throttled", """WITH RECURSIVE o AS (SELECT scan_id, at_ms, row_number() OVER (PARTITION BY scan_id ORDER BY at_ms, id) AS k FROM ev),
  f AS (SELECT scan_id, k, at_ms AS last, 1 AS n, true AS emitted FROM o WHERE k = 1 UNION ALL
    SELECT o.scan_id, o.k, CASE WHEN o.at_ms - f.last >= 36000000 THEN o.at_ms ELSE f.last END, f.n + (o.at_ms - f.last >= 36000000)::INT, o.at_ms - f.last >= 36000000 FROM f JOIN o ON o.scan_id = f.scan_id AND o.k = f.k + 1)
  SELECT scan_id, (max_by(n, k) + (NOT max_by(emitted, k))::INT)::BIGINT AS emitted, max(k)::BIGINT AS n FROM f GROUP BY scan_id""")
def _(spark, d):
    return ordered.throttled(events(spark, d), "scan_id", "at_ms", ["at_ms", "id"], 36_000_000)


@P.add("agg13_cumulative_mean", "SELECT scan_id, n, round(mean, 6) AS mean FROM (SELECT scan_id, row_number() OVER w AS n, avg(value) OVER w AS mean FROM ev WINDOW w AS (PARTITION BY scan_id ORDER BY id)) WHERE n % 20 = 0")
def _(spark, d):
    return ordered.cumulative_mean(events(spark, d), "scan_id", "id", "value", 20).select("scan_id", "n", r6(F.col("mean"), "mean"))


_WANTED = "['validated','tracking','completed','failed','proposed'][(id % 5 + 1)::INT]"
_LEGAL = "list_contains(['proposed>validated','validated>proposed','validated>tracking','tracking>completed','tracking>failed','proposed>failed','validated>failed','completed>failed','failed>proposed'], {a} || '>' || {b})"


def _wanted():
    return F.element_at(F.array(*[F.lit(s) for s in ("validated", "tracking", "completed", "failed", "proposed")]), (F.col("id") % 5 + 1).cast("int"))


@P.add("rev3_status_replay", f"SELECT scan_id, list_reduce(list_prepend('proposed', list({_WANTED} ORDER BY id)), lambda s, x: CASE WHEN s = x OR {_LEGAL.format(a='s', b='x')} THEN x ELSE s END) AS status, count(*)::BIGINT AS n_changes FROM ev GROUP BY scan_id")
def _(spark, d):
    return review.replay(events(spark, d).withColumn("wanted", _wanted()), "scan_id", ["id"], "wanted")


@P.add("rev2_transitions", f"SELECT s.scan_id, s.status AS old, w AS new, s.status = w OR {_LEGAL.format(a='s.status', b='w')} AS allowed FROM ses s, (SELECT unnest(['proposed','validated','tracking','completed','failed']) AS w)")
def _(spark, d):
    wanted = F.explode(F.array(*[F.lit(s) for s in ("proposed", "validated", "tracking", "completed", "failed")]))
    rows = sessions(spark, d).select("scan_id", F.col("status").alias("old"), wanted.alias("new"))
    edges = review.transition_table(spark).withColumn("edge", F.lit(True))
    joined = rows.join(F.broadcast(edges), ["old", "new"], "left")  # nine edges
    return joined.select("scan_id", "old", "new", (F.coalesce("edge", F.lit(False)) | (F.col("old") == F.col("new"))).alias("allowed"))


@P.add("rev3_guarded_set", f"SELECT id, CASE WHEN s = w OR {_LEGAL.format(a='s', b='w')} THEN w ELSE s END AS status FROM (SELECT ev.id, ses.status AS s, {_WANTED.replace('(id ', '(ev.id ')} AS w FROM ev JOIN ses USING (scan_id))")
def _(spark, d):
    rows = events(spark, d).join(sessions(spark, d).select("scan_id", "status"), "scan_id")
    return rows.select("id", guarded(F.col("status"), _wanted()).alias("status"))


# Review: a scan per label; pairs, resolutions and choices by arithmetic on ids.
_REV = """c AS (SELECT id, scan_id, confidence, row_number() OVER (PARTITION BY scan_id ORDER BY id) AS k FROM cand),
  p AS (SELECT x.scan_id, x.id AS a, y.id AS b, x.k AS pos FROM c x JOIN c y ON x.scan_id = y.scan_id AND y.k = x.k + 1 WHERE x.k % 3 = 0),
  r AS (SELECT scan_id, CASE WHEN pos % 2 = 0 THEN a ELSE b END AS a, CASE WHEN pos % 2 = 0 THEN b ELSE a END AS b, CASE WHEN pos % 5 = 0 THEN -1 WHEN pos % 4 = 0 THEN a ELSE b END AS keep, pos FROM p WHERE pos % 6 <> 0),
  n AS (SELECT scan_id, least(a, b) AS a, greatest(a, b) AS b, keep, CASE WHEN keep = least(a, b) THEN greatest(a, b) ELSE least(a, b) END AS gone FROM r WHERE keep = a OR keep = b),
  x AS (SELECT scan_id, id FROM c WHERE k % 7 = 0 UNION SELECT scan_id, gone FROM n),
  act AS (SELECT c.* FROM c ANTI JOIN x ON c.scan_id = x.scan_id AND c.id = x.id)"""


def _review(spark, d):


    c = candidates(spark, d).select("id", "scan_id", "confidence", F.row_number().over(Window.partitionBy("scan_id").orderBy("id")).alias("k"))
    after = c.select("scan_id", F.col("id").alias("b"), (F.col("k") - 1).alias("k"))
    p = c.join(after, ["scan_id", "k"]).filter("k % 3 = 0").select("scan_id", F.col("id").alias("a"), "b", F.col("k").alias("pos"))
    keep = F.when(F.col("pos") % 5 == 0, -1).when(F.col("pos") % 4 == 0, F.col("a")).otherwise(F.col("b"))
    even = F.col("pos") % 2 == 0
    r = p.filter("pos % 6 <> 0").select("scan_id", F.when(even, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("b"), keep.alias("keep"), "pos")
    return c, p, r, c.filter("k % 7 = 0").select("scan_id", "id")


@P.add("set2_resolutions", f"WITH {_REV} SELECT scan_id, a, b, keep, gone AS drop FROM n")
def _(spark, d):
    _, _, r, _ = _review(spark, d)
    return review.normalised_resolutions(r.unionByName(r.withColumn("pos", F.col("pos") + 1000)))


@P.add("set1_excluded", f"WITH {_REV} SELECT scan_id, id FROM x")
def _(spark, d):
    _, _, r, user = _review(spark, d)
    return review.excluded_ids(user, review.normalised_resolutions(r))


@P.add("fil13_active", f"WITH {_REV} SELECT scan_id, id FROM act")
def _(spark, d):
    c, _, r, user = _review(spark, d)
    return review.active(c, review.excluded_ids(user, review.normalised_resolutions(r))).select("scan_id", "id")


@P.add("jn7_unresolved", f"WITH {_REV} SELECT p.scan_id, p.a, p.b FROM p ANTI JOIN x x1 ON x1.scan_id = p.scan_id AND x1.id = p.a ANTI JOIN x x2 ON x2.scan_id = p.scan_id AND x2.id = p.b ANTI JOIN n ON n.scan_id = p.scan_id AND n.a = least(p.a, p.b) AND n.b = greatest(p.a, p.b)")
def _(spark, d):
    _, p, r, user = _review(spark, d)
    done = review.normalised_resolutions(r)
    return review.unresolved_pairs(p, review.excluded_ids(user, done), done).select("scan_id", "a", "b")


@P.add("jn8_pending_splits", f"WITH {_REV} SELECT scan_id, id FROM act WHERE k % 11 = 0")
def _(spark, d):
    c, _, r, user = _review(spark, d)
    splits = c.filter("k % 11 = 0").select("scan_id", "id")
    return review.active(c, review.excluded_ids(user, review.normalised_resolutions(r))).join(splits, ["scan_id", "id"], "left_semi").select("scan_id", "id")


_BLOCK = f"""WITH {_REV}, inv AS (SELECT scan_id, count(*) AS v FROM r WHERE keep <> a AND keep <> b GROUP BY scan_id),
  per AS (SELECT scan_id, count(*) AS active, count(*) FILTER (WHERE confidence < 0.55 AND k % 2 = 1) AS low, count(*) FILTER (WHERE k % 11 = 0) AS splits, count(*) FILTER (WHERE k = 1) AS chosen FROM act GROUP BY scan_id),
  un AS (SELECT p.scan_id, count(*) AS v FROM p ANTI JOIN x x1 ON x1.scan_id = p.scan_id AND x1.id = p.a ANTI JOIN x x2 ON x2.scan_id = p.scan_id AND x2.id = p.b ANTI JOIN n ON n.scan_id = p.scan_id AND n.a = least(p.a, p.b) AND n.b = greatest(p.a, p.b) GROUP BY p.scan_id)
  SELECT scan_id, active::BIGINT AS active_count, concat_ws('|', CASE WHEN inv.v > 0 THEN 'invalid duplicate resolution entries: ' || inv.v END, CASE WHEN active <> 40 THEN 'member count mismatch: expected 40, active ' || active END,
    CASE WHEN un.v > 0 THEN 'unresolved duplicate pairs: ' || un.v END, CASE WHEN low > 0 THEN 'unconfirmed low-confidence identities: ' || low END, CASE WHEN splits > 0 THEN 'pending split review identities: ' || splits END,
    CASE WHEN chosen = 0 THEN 'no valid selected target identity' END) AS blockers FROM per LEFT JOIN un USING (scan_id) LEFT JOIN inv USING (scan_id)"""


def _blockers(spark, d):
    c, p, r, user = _review(spark, d)
    scans = c.groupBy("scan_id").agg(F.lit(40).cast("long").alias("expected_count"), F.min("id").alias("selected_id"))
    accepted = c.filter("k % 2 = 0").select("scan_id", "id")
    return review.blockers(scans, c, p, r, user, accepted, c.filter("k % 11 = 0").select("scan_id", "id"))


@P.add("rev1_blockers", _BLOCK)
def _(spark, d):
    return _blockers(spark, d).select("scan_id", "active_count", F.array_join("blockers", "|").alias("blockers"))


@P.add("rev4_apply_review", _BLOCK.replace("SELECT scan_id, active::BIGINT", "SELECT * FROM (SELECT scan_id, active::BIGINT", 1).replace("SELECT * FROM (SELECT scan_id, active::BIGINT AS active_count, ", "SELECT scan_id, blockers = '' AS review_ready, 0.77::DOUBLE AS validated_threshold, CASE WHEN blockers = '' THEN CASE WHEN st IN ('proposed', 'validated') THEN 'validated' ELSE st END ELSE CASE WHEN st IN ('proposed', 'validated', 'failed') THEN 'proposed' ELSE st END END AS status FROM (SELECT scan_id, ses.status AS st, ") + " JOIN ses USING (scan_id))")
def _(spark, d):
    out = review.apply_review(sessions(spark, d), _blockers(spark, d), 0.77, 1_706_600_000_000)
    return out.select("scan_id", "review_ready", "validated_threshold", "status")


@P.add("rev7_rescan_applied", f"SELECT scan_id, false AS review_ready, CASE WHEN status IN ('proposed', 'validated', 'failed') THEN 'proposed' ELSE status END AS status FROM ses WHERE user_id % 4 = 1")
def _(spark, d):
    rows = sessions(spark, d)
    return review.rescan_applied(rows, rows.filter("user_id % 4 = 1"), 1_706_600_000_000).select("scan_id", "review_ready", "status")


def _track_frames(spark, d):
    """A track per 400 orders: recognised and person boxes of each order, in order."""
    seen = best_per_frame(observations(spark, d), 8, F.col("similarity"))
    rows = seen.groupBy("frame_index").agg(F.array_sort(F.collect_list(F.struct("rank", "x1", "y1", "x2", "y2", "similarity", "margin", "body_similarity"))).alias("seen"))
    persons = boxes(spark, d).groupBy("frame_index").agg(F.array_sort(F.collect_list(F.struct("box_id", "x1", "y1", "x2", "y2"))).alias("persons"))
    return rows.join(persons, "frame_index").withColumn("track_id", F.concat(F.lit("track-"), F.floor(F.col("frame_index") / 400).cast("string")))


@P.add("trk1_camera")
def _(spark, d):
    return tracking.track(_track_frames(spark, d))


@P.add("trk2_states")
def _(spark, d):
    return tracking.track(_track_frames(spark, d)).groupBy("track_id", "state").agg(F.count("*").alias("frames"), F.count_if("recognised").alias("recognised"))


@P.add("trk4_frames_conserved", "SELECT 'track-' || floor(frame_index / 400)::BIGINT AS track_id, count(DISTINCT frame_index)::BIGINT AS frames FROM bx GROUP BY 1")
def _(spark, d):
    return tracking.track(_track_frames(spark, d)).groupBy("track_id").agg(F.count("*").alias("frames"))


# Outputs by the run's number: folders under /d (some of which are files or missing), the root, names with needless parts.
_FILES = "ff AS (SELECT '/f/' || s_suppkey AS path, s_suppkey % 10 = 0 AS folder FROM supplier UNION ALL SELECT '/d/' || s_suppkey, s_suppkey % 7 <> 0 FROM supplier UNION ALL SELECT '/', true UNION ALL SELECT '/d', true)"
_RUNS = """rn AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 13 = 0 THEN '/f/./' || (o_orderkey % 110) ELSE '/f/' || (o_orderkey % 110) END AS video, o_orderkey % 110 AS v, o_orderkey % 105 AS o, '/f/' || (o_orderkey % 107) AS bias, '/f/' || (o_orderkey % 103) AS detector,
  '/f/' || (o_orderkey % 101) AS face_model, CASE WHEN o_orderkey % 3 = 0 THEN '/f/' || (o_orderkey % 109) ELSE ' ' END AS body_model, o_orderkey % 2 AS n_targets, o_orderkey % 5 AS n_gallery,
  CASE WHEN o_orderkey % 47 = 0 THEN 'nan'::DOUBLE ELSE 0.1::DOUBLE END AS margin, o_orderkey % 4 > 0 AS has_default_body,
  CASE WHEN o_orderkey % 50 = 0 THEN 1 WHEN o_orderkey % 23 = 0 THEN 2 WHEN o_orderkey % 19 = 0 THEN 3 WHEN o_orderkey % 17 = 0 THEN 4 WHEN o_orderkey % 11 = 0 THEN 5 WHEN o_orderkey % 29 = 0 THEN 6 ELSE 7 END AS shape FROM orders)"""
_IS_FILE = "EXISTS (SELECT 1 FROM ff WHERE NOT folder AND path = {0})"
# what each shape's output resolves to and the folder that it lies in, written out by hand
_SHAPES = """sh AS (SELECT *, shape IN (2, 3) AS own, CASE shape WHEN 4 THEN '/' WHEN 5 THEN '/d' WHEN 7 THEN '/d/' || o END AS above, shape = 6 AS root FROM rn)"""


@P.add("rev9_preflight", f"""WITH {_FILES}, {_RUNS}, {_SHAPES} SELECT run_id, CASE WHEN NOT {_IS_FILE.format("'/f/' || v")} THEN 'input video not found: ' || video
  WHEN n_targets + n_gallery = 0 AND NOT {_IS_FILE.format('bias')} THEN 'bias image not found: ' || bias WHEN isnan(margin) THEN 'identity margin threshold must be finite'
  WHEN body_model <> ' ' AND NOT {_IS_FILE.format('body_model')} THEN 'body reid model not found: ' || body_model WHEN body_model = ' ' AND n_gallery > 0 AND NOT has_default_body THEN '{review.NO_BODY_MODEL}'
  WHEN NOT {_IS_FILE.format('detector')} THEN 'YOLO model not found: ' || detector WHEN NOT {_IS_FILE.format('face_model')} THEN 'face model not found: ' || face_model
  WHEN shape = 1 THEN 'output path is empty' WHEN own THEN 'output path must be different from input video path' WHEN root THEN 'output path has no parent directory'
  WHEN NOT EXISTS (SELECT 1 FROM ff WHERE path = above) THEN 'output directory does not exist: ' || above
  WHEN {_IS_FILE.format('above')} THEN 'output parent is not a directory: ' || above END AS problem FROM sh""")
def _(spark, d):
    key = F.col("o_orderkey")
    path = lambda top, n, end="": F.concat(F.lit(top), (key % n).cast("string"), F.lit(end))
    output = (
        F.when(key % 50 == 0, " ").when(key % 23 == 0, path("/f//", 110)).when(key % 19 == 0, path("/d/../f/./", 110, "/")).when(key % 17 == 0, F.lit("/out.mp4"))
        .when(key % 11 == 0, path("/d/", 105, "//")).when(key % 29 == 0, F.lit("//./")).otherwise(path("/d/", 105, "/./out"))
    )
    runs = table(spark, d, "orders").select(
        key.alias("run_id"), F.when(key % 13 == 0, path("/f/./", 110)).otherwise(path("/f/", 110)).alias("video"), path("/f/", 107).alias("bias"), path("/f/", 103).alias("detector"),
        path("/f/", 101).alias("face_model"), F.when(key % 3 == 0, path("/f/", 109)).otherwise(" ").alias("body_model"), output.alias("output"),
        (key % 2).alias("n_targets"), (key % 5).alias("n_gallery"), F.when(key % 47 == 0, float("nan")).otherwise(0.1).alias("margin"), (key % 4 > 0).alias("has_default_body"))
    made = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    files = made.select(F.concat(F.lit("/f/"), F.col("k").cast("string")).alias("path"), (F.col("k") % 10 == 0).alias("is_folder"))
    files = files.unionByName(made.select(F.concat(F.lit("/d/"), F.col("k").cast("string")).alias("path"), (F.col("k") % 7 != 0).alias("is_folder")))
    files = files.unionByName(spark.createDataFrame([("/", True), ("/d", True)], "path string, is_folder boolean"))
    return review.preflight(runs, files)
