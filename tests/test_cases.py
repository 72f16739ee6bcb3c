"""Hand-made cases: boundaries, ties and gaps that the tables don't hold."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import boxes as fb
from kindred.functions import paths as fp
from kindred.functions.boxes import Box
from kindred.functions.rules import TRANSITIONS, can_follow, known_status
from kindred.functions.vectors import dot, unit_or_empty
from kindred.operators import catalog, clustering, detections, galleries, ordered, queues, review, sessions
from kindred.operators.tracking import LOCKED, LOST, RECOVERING, SEARCHING, Motion, Rect, Seen, Tracker
from kindred.sources import bundle_listing, legacy_store


def box(x, y, half=40):
    return Rect(x - half, y - half, x + half, y + half)


def seen(x, y, similarity=0.78, margin=0.12):
    return [Seen(box(x, y), similarity, margin)]


def locked(x=300, y=260):
    t = Tracker()
    t.recognised(seen(x, y), 0.6, 0.03)
    t.recognised(seen(x + 2, y + 1), 0.6, 0.03)
    return t


def test_suppression_keeps_two(spark):
    rows = spark.createDataFrame([(1, 1, 10.0, 10.0, 110.0, 210.0, 0.95), (1, 2, 14.0, 15.0, 108.0, 212.0, 0.91), (1, 3, 300.0, 20.0, 360.0, 180.0, 0.70), (1, 4, 0.0, 0.0, 9.0, 9.0, float("nan"))],
                                 "frame_index long, box_id int, x1 double, y1 double, x2 double, y2 double, confidence double")
    assert sorted(r.x1 for r in detections.suppress(rows).collect()) == [10.0, 300.0]


def test_suppression_invariant(spark):
    rng = random.Random(1)
    rows = [(f, i, x := rng.random() * 100, y := rng.random() * 100, x + 30 + rng.random() * 40, y + 30, rng.random()) for f in range(20) for i in range(12)]
    kept = detections.suppress(spark.createDataFrame(rows, "frame_index long, box_id int, x1 double, y1 double, x2 double, y2 double, confidence double"), 0.4).collect()
    for a in kept:
        for b in kept:
            if a.frame_index == b.frame_index and a.box_id < b.box_id:
                assert Rect(a.x1, a.y1, a.x2, a.y2).iou(Rect(b.x1, b.y1, b.x2, b.y2)) <= 0.4


def test_crops_stay_inside(spark):
    rows = spark.createDataFrame([(1810.0, 2.0, 1918.0, 620.0), (-5.0, -9.0, 3.0, 4.0), (1919.5, 1079.5, 1920.0, 1080.0)], "x1 double, y1 double, x2 double, y2 double")
    w, h = F.lit(1920).cast("long"), F.lit(1080).cast("long")
    for r in rows.select(*[c.alias(n) for c, n in zip(fb.face_crop(Box.of(), w, h), "xywh")]).collect():
        assert r.w > 0 and r.h > 0 and r.x + r.w <= 1920 and r.y + r.h <= 1080


def test_hint_beats_confidence(spark):
    rows = spark.createDataFrame([(95.0, 95.0, 145.0, 230.0, 0.50), (500.0, 500.0, 560.0, 700.0, 0.60)], "x1 double, y1 double, x2 double, y2 double, confidence double")
    near, far = [r.s for r in rows.select(fb.candidate_rank(Box.of(), F.col("confidence"), (F.lit(120.0), F.lit(150.0))).alias("s")).collect()]
    assert near > far
    assert rows.select(fb.candidate_rank(Box.of(), F.col("confidence"), None).alias("s")).first().s == 0.5


def test_degenerate_boxes(spark):
    row = spark.range(1).select(fb.iou(Box(*map(F.lit, (0.0, 0.0, 0.0, 5.0))), Box(*map(F.lit, (0.0, 0.0, 0.0, 5.0)))).alias("i"), fb.iou(Box(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), Box(*map(F.lit, (5.0, 5.0, 6.0, 6.0)))).alias("j")).first()
    assert (row.i, row.j) == (0.0, 0.0)


def test_presence_prefers_faces(spark):
    painted = [("face", y, x, 40.0 if (y - 9) ** 2 + (min(x, 19 - x) - 5) ** 2 < 8 else 200.0 if y < 8 else 120.0 + 40 * ((x + y) % 2)) for y in range(24) for x in range(20)]
    flat = [("flat", y, x, 128.0) for y in range(24) for x in range(20)]
    found = {r.image: r.presence for r in detections.presence_score(spark.createDataFrame(painted + flat, "image string, row long, col long, luma double")).collect()}
    assert found["face"] > found["flat"]


def test_presence_of_pixels_and_grids(spark):
    rng = np.random.default_rng(5)
    grids = {"a": rng.uniform(0, 255, (8, 6)), "b": rng.uniform(0, 255, (5, 9)), "c": rng.uniform(0, 255, (1, 7)), "d": np.full((2, 2), np.nan), "e": rng.uniform(0, 255, (3, 4))}
    grids["e"][1, 2] = np.nan

    def mean(values):
        values = [v for v in values if v == v]
        return sum(values) / len(values) if values else 0.0

    def slow(g):
        rows, cols = g.shape
        edge = {(r, c): abs(g[r, c] - g[r, c + 1]) + abs(g[r, c] - g[r + 1, c]) for r in range(rows - 1) for c in range(cols - 1)}
        inner = sum(v for (r, c), v in edge.items() if v == v and rows // 4 <= r <= rows * 3 // 4 and cols // 4 <= c <= cols * 3 // 4)
        outer = sum(v for v in edge.values() if v == v) - inner
        m = mean(g.ravel())
        sd = mean([(v - m) ** 2 for v in g.ravel()]) ** 0.5
        asym = mean([abs(g[r, c] - g[r, cols - 1 - c]) for r in range(rows) for c in range(cols // 2)])
        apart = abs(mean(g[: rows // 3].ravel()) - mean(g[rows * 2 // 3 :].ravel()))
        part = lambda x, low, wide: min(max((x - low) / wide, 0), 1)
        return part(sd, 12, 38) * 0.24 + part(mean(edge.values()), 7, 26) * 0.22 + part(58 - asym, 0, 58) * 0.20 + part(inner / max(outer, 1e-3), 0.75, 0.85) * 0.22 + part(apart, 10, 42) * 0.12

    want = {k: slow(g) for k, g in grids.items()}
    pixels = [(k, r, c, None if np.isnan(g[r, c]) else float(g[r, c])) for k, g in grids.items() for r in range(g.shape[0]) for c in range(g.shape[1])]
    pixels.remove(("e", 1, 2, None))  # a gap in a grid
    got = {r.image: r.presence for r in detections.presence_score(spark.createDataFrame(pixels[::-1], "image string, row int, col int, luma double")).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    lines = [(k, g.shape[1], [None if np.isnan(v) else float(v) for v in g.ravel()]) for k, g in grids.items()] + [("f", 3, [1.0] * 4), ("g", 0, [1.0]), ("h", None, [1.0]), ("i", 2, None), ("j", 2, [])]
    found = detections.presence_of_grids(spark.createDataFrame(lines, "image string, cols int, luma array<double>"))
    assert {r.image: r.presence for r in found.collect() if r.image in want} == pytest.approx(want, abs=1e-9)
    assert {r.image for r in found.filter("presence is null").collect()} == set("fghij")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_vectors(spark):
    row = spark.range(1).select(dot(F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("d"), unit_or_empty(F.array(F.lit(0.0))).alias("u")).first()
    assert (row.d, row.u) == (11.0, [])


def test_empty_and_unequal_galleries(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    none = rows.filter("id > 9").select("embedding")
    out = galleries.target_margin(rows, rows.filter("id = 1").select("embedding"), none, "id").collect()
    assert {r.id: (r.similarity, r.impostor_similarity, r.margin) for r in out} == {1: (1.0, -1.0, 2.0), 2: (0.0, -1.0, 1.0)}
    longer = spark.createDataFrame([([1.0, 0.0, 0.0],)], "embedding array<double>")
    assert [r.b for r in galleries.best_in_gallery(rows, longer, "id", "b", same_length=True).collect()] == [None, None]
    many = spark.createDataFrame([([np.cos(k / 500.0).item(), np.sin(k / 500.0).item()],) for k in range(2500)], "embedding array<double>")
    assert all(r.b > 0.999 for r in galleries.best_in_gallery(rows, many, "id", "b").collect())


def _cluster(vectors, gate, frames=None):
    c = clustering.Clusters(gate)
    for i, v in enumerate(vectors):
        v = np.array(v, float)
        c.add(i, 90.0, 150.0, 0.9, v / np.linalg.norm(v), 0.8, 0.9)
    return c


def test_clusters_merge_and_split():
    assert _cluster([[1, 0, 0, 0], [0.98, 0.01, 0, 0]], 0.75).seen == [2]
    assert _cluster([[1, 0, 0, 0], [0, 1, 0, 0]], 0.85).seen == [1, 1]


def test_agglomeration_matches_a_plain_loop():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = rng.normal(size=(4, 6))
        vectors = [base[rng.integers(4)] + rng.normal(size=6) * 0.25 for _ in range(25)]
        c = _cluster(vectors, 0.97)
        state = [[c.centroids[i].copy(), n] for i, n in enumerate(c.seen)]
        merges = 0
        while True:
            best = None
            for i in range(len(state)):
                for j in range(i + 1, len(state)):
                    s = float(state[i][0] @ state[j][0])
                    if (s >= 0.84 or (s >= 0.80 and state[i][1] + state[j][1] >= 5)) and (best is None or s > best[0]):
                        best = (s, i, j)
            if best is None:
                break
            _, i, j = best
            v, n = state[j]
            state[j] = state[-1]
            state.pop()
            mixed = state[i][0] * state[i][1] + v * n
            state[i] = [mixed / np.linalg.norm(mixed), state[i][1] + n]
            merges += 1
        assert c.merge() == merges and c.seen == [n for _, n in state]
        assert np.allclose(c.centroids, [v for v, _ in state])


def test_discovery_rows(spark):
    rows = [(f"s{k}", i, 0.1, 0.1, 0.9, [1.0, float(i % 2) / 50, 0.0], 0.8, 1.0) for k in range(3) for i in range(10)]
    frame = spark.createDataFrame(rows, "scan_id string, frame_index long, anchor_x double, anchor_y double, confidence double, embedding array<double>, face_presence double, quality double")
    out = clustering.discover(frame, clustering.Config.of_mode("balanced")).collect()
    assert {(r.scan_id, r.observations, r.first_frame, r.last_frame, r.all_observations) for r in out} == {(f"s{k}", 10, 0, 9, 10) for k in range(3)}
    assert out[0].confidence <= 0.995


def test_second_pass_rule():
    rule = clustering.needs_second_pass
    assert rule(3, 0, False, 5, "fast") and not rule(4, 0, False, 5, "fast")
    assert rule(3, 1, False, None, "quality") and not rule(3, 1, False, None, "fast") and rule(9, 0, True, None, "fast")


def test_motion_matches_matrices():
    f = np.eye(4)
    f[0, 2] = f[1, 3] = 1
    h, x, p = np.eye(2, 4), np.array([10.0, 20.0, 0, 0]), np.eye(4) * 100
    m = Motion(10.0, 20.0)
    for z in ((12.0, 21.0), (15.0, 25.0), None, (19.0, 22.0)):
        x, p = f @ x, f @ p @ f.T + np.eye(4) * 4
        m.predict()
        if z:
            k = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.eye(2) * 16)
            x, p = x + k @ (np.array(z) - h @ x), (np.eye(4) - k @ h) @ p
            m.correct(*z)
        assert np.allclose(x, [m.x, m.y, m.vx, m.vy]) and np.isclose(p[0, 2], m.pv) and np.isclose(p[3, 3], m.vv)


def test_tracker_locks_after_two():
    t = Tracker()
    assert t.state == SEARCHING
    t.recognised(seen(100, 100), 0.6, 0.03)
    assert t.state == RECOVERING
    t.recognised(seen(102, 101, 0.79, 0.13), 0.6, 0.03)
    assert t.state == LOCKED


def test_tracker_refuses_an_ambiguous_jump():
    t = locked(200, 200)
    out = t.recognised([*seen(900, 900, 0.67, 0.05), *seen(870, 880, 0.66, 0.05)], 0.6, 0.03)
    assert out[0] < 220


def test_tracker_holds_then_ends():
    t = locked()
    outs = [t.recognised([], 0.6, 0.03) for _ in range(31)]
    assert [o and o[3] for o in outs] == ["predicted"] * 6 + ["held"] * 24 + [None]


def test_tracker_loses_and_resets():
    t = locked()
    states = []
    for _ in range(91):
        t.recognised([], 0.6, 0.03)
        states.append(t.state)
    assert states[17] == RECOVERING and states[18] == LOST and states[89] == LOST and states[90] == SEARCHING and t.frame == 93


def test_tracker_takes_the_second_vote():
    t = locked(120, 120)
    first = t.recognised(seen(860, 760, 0.66, 0.05), 0.6, 0.03)
    second = t.recognised(seen(860, 760, 0.66, 0.05), 0.6, 0.03)
    assert first[3] != "observed" and second[3] == "observed"


def test_tracker_follows_a_person():
    t = locked(260, 220)
    x, y, _, source, _ = t.supported([box(264, 224)])
    assert source == "predicted" and abs(x - 264) < 80 and abs(y - 224) < 80
    before = t.frame
    t.supported([])
    assert t.frame == before + 2


def test_queue_dedupe_retry_and_depths(spark):
    rows = spark.createDataFrame([("discovery", 1, "m", "j1", "k", 0, 0), ("rescan", 2, "m", "j2", "k", 0, 1), ("rescan", 3, "m", "j3", "other", 0, 2)],
                                 "queue string, seq long, message_type string, job_id string, idempotency_key string, created_at_ms long, attempt long")
    assert sorted(r.seq for r in queues.enqueue(rows).collect()) == [1, 3]
    assert [r.deduplicated for r in queues.accepted(rows).orderBy("seq").collect()] == [False, True, False]
    assert [(r.route, r.attempt) for r in queues.after_failure(rows).orderBy("seq").collect()] == [("retry", 1), ("retry", 2), ("dlq", 2)]
    assert {r.queue: r.depth for r in queues.depths(spark, rows).collect()} == {"discovery": 1, "rescan": 2, "tracking_start": 0, "tracking_monitor": 0, "dlq": 0}
    assert json.loads(queues.envelope(rows, ["job_id"]).filter("seq = 1").first().body)["payload"] == {"job_id": "j1"}


def test_paging_and_trim(spark):
    s = spark.createDataFrame([("scan-1", "proposed", 1_000), ("scan-2", "validated", 11_000), ("scan-10", "validated", 11_000)], "scan_id string, status string, updated_at_ms long")
    e = spark.createDataFrame([(i, "scan-2", 11_000 + i, a, "") for i, a in enumerate(["made", "b%x", "B end"])], "id long, scan_id string, at_ms long, action string, details string")
    assert [r.scan_id for r in sessions.session_page(s, sessions.Page.of(2)).collect()] == ["scan-2", "scan-10"]
    assert [r.scan_id for r in sessions.session_page(s, sessions.Page.of(2, 99, (11_000, "scan-10"))).collect()] == ["scan-1"]
    assert sessions.Page.of(2, 99, (1, "x")).offset_ignored and sessions.next_cursor([], "scan_id") is None
    assert {r.scan_id: r.event_count for r in sessions.with_event_counts(s, e).collect()} == {"scan-1": 0, "scan-2": 3, "scan-10": 0}
    assert [len(r.events) for r in sessions.with_events(s, e).orderBy("scan_id").collect()] == [0, 0, 3]
    assert e.filter(sessions.event_filter(action="b")).count() == 2 and e.filter(sessions.event_filter(action="%")).count() == 3
    assert e.filter(sessions.event_filter(since=11_001)).count() == 2 and e.filter(sessions.event_filter(until=11_001)).count() == 2
    out = sessions.maintenance(s, e, 70_000, 60_000, 1)
    assert {r.scan_id for r in out["sessions"].collect()} == {"scan-2", "scan-10"} and out["events"].count() == 3
    assert tuple(out["counts"].first()) == (1, 0)
    assert tuple(sessions.maintenance(s.limit(0), e.limit(0), 0)["counts"].first()) == (0, 0)


def test_versions(spark, tmp_path):
    path = sessions.save(spark.range(3), str(tmp_path), 1)
    assert spark.read.parquet(path).count() == 3 and path.endswith("v000001")


def test_transitions(spark):
    pairs = [("proposed", "validated", True), ("validated", "tracking", True), ("tracking", "completed", True), ("proposed", "tracking", False), ("completed", "tracking", False), ("failed", "failed", True)]
    rows = spark.createDataFrame(pairs, "old string, new string, want boolean")
    assert rows.filter(can_follow(F.col("old"), F.col("new")) != F.col("want")).count() == 0
    assert review.transition_table(spark).count() == len(TRANSITIONS) == 9
    assert spark.createDataFrame([("odd",)], "s string").select(known_status(F.col("s")).alias("s")).first().s == "proposed"
    changes = spark.createDataFrame([("a", 1, "validated"), ("a", 2, "tracking"), ("a", 3, "completed"), ("a", 4, "validated")], "scan_id string, id long, wanted string")
    assert review.replay(changes, "scan_id", ["id"], "wanted").first().status == "completed"


def test_reversed_and_invalid_resolutions(spark):
    rows = spark.createDataFrame([("s", 2, 1, 1, 0), ("s", 1, 2, 2, 1), ("s", 3, 4, 9, 2)], "scan_id string, a long, b long, keep long, pos long")
    assert [tuple(r) for r in review.normalised_resolutions(rows).collect()] == [("s", 1, 2, 1, 2)]
    assert review.invalid_resolutions(rows).first().invalid == 1


def test_preflight():
    review.check_run("a.mp4", "b.mp4", 0.5, lambda p: True)
    for bad in (("a.mp4", "a.mp4", 0.5), ("a.mp4", " ", 0.5), ("a.mp4", "b.mp4", 1.5), ("", "b.mp4", 0.5)):
        with pytest.raises(ValueError):
            review.check_run(*bad, lambda p: True)


def test_paths(spark):
    cases = [("/", "/", None), ("//", "/", None), ("/out.mp4", "/out.mp4", "/"), ("/d/x/", "/d/x", "/d"), ("/d/./v.mp4", "/d/v.mp4", "/d"), ("/d//x/./", "/d/x", "/d"), ("x", "/w/x", ""),
             ("./x", "/w/x", "."), ("a/b", "/w/a/b", "a"), ("/a/../b", "/b", "/a/.."), ("/../b", "/b", "/.."), ("/a//b/c", "/a/b/c", "/a//b"), ("/./a", "/a", "/"), ("..", "/", "")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, path string, whole string, above string")
    assert [(r.a, r.b) for r in rows.select("i", fp.resolved(F.col("path"), "/w").alias("a"), fp.parent(F.col("path")).alias("b")).orderBy("i").collect()] == [c[1:] for c in cases]


def test_preflight_of_unusual_paths(spark):
    files = spark.createDataFrame([("/", True), ("/d", True), ("/d/v.mp4", False), ("/d/m", False)], "path string, is_folder boolean")
    def problem(output, video="/d/v.mp4", at="/"):
        runs = spark.createDataFrame([(1, video, "", "/d/m", "d//m" if at == "/" else "m", "/d/m", output, 1, 0, 0.1, True)], "run_id long, video string, bias string, detector string, face_model string, body_model string, output string, n_targets int, n_gallery int, margin double, has_default_body boolean")
        (first,), (second,) = ([r.problem for r in review.preflight(runs, files, at, most).collect()] for most in (0, 1 << 20))
        assert first == second
        return first
    assert problem("/out.mp4") is None and problem("/d/x/") is None and problem("/d/./x") is None and problem("out", at="/d") == "output directory does not exist: "
    assert problem("/d/./v.mp4") == problem("/d/v.mp4/") == problem("d/../d//v.mp4") == "output path must be different from input video path"
    assert problem("/") == "output path has no parent directory" and problem("/x/y") == "output directory does not exist: /x"
    assert problem("/d/m/y") == "output parent is not a directory: /d/m" and problem("/o", "/d/v.mp4/") == "input video not found: /d/v.mp4/" and problem("/o", "/d/./v.mp4") is None


def folded_by_hand(rows, gap):
    """EMA, emitted and n of each key, row after row."""
    out = {}
    for key, _, at, value in sorted(rows):
        ema, last, n, total, _ = out.get(key, (0.6, None, 0, 0, None))
        emit = last is None or at - last >= gap
        out[key] = (ema * 0.85 + value * 0.15, at if emit else last, n + emit, total + 1, emit)
    return {k: (round(e, 9), n + (not emit), total) for k, (e, _, n, total, emit) in out.items()}


@pytest.mark.parametrize("gap", [0, 1, 7, 180, 10**9])
def test_folds_in_pieces_are_folds(spark, gap, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 8)
    rng = random.Random(gap)
    rows, at = [], 0
    for i in range(3000):
        at += rng.choice([0, 0, 1, 3, 50])
        rows.append((rng.choice(["hot"] * 8 + ["a", "b", "c"]), i, at, rng.random()))
    rows += [("one", 5000, 3, 0.5), (None, 5001, 4, 0.25), (None, 5002, 5, 0.75)]
    df = spark.createDataFrame(rows, "key string, id long, at long, value double").repartition(7)
    ema = {r.key: (r.state, r.n) for r in ordered.smoothed(df, "key", ["id"], F.col("value")).collect()}
    thin = {r.key: (r.emitted, r.n) for r in ordered.throttled(df, "key", "at", ["at", "id"], gap).collect()}
    want = folded_by_hand([(k or "", *x) for k, *x in rows], gap)
    assert {k or "": (round(s, 9), thin[k][0], n) for k, (s, n) in ema.items()} == want and all(thin[k][1] == ema[k][1] for k in ema)
    every = {(r.key, r.id): r.state for r in ordered.smoothed_rows(df.filter("key is not null"), "key", ["id"], F.col("value")).collect()}
    now = {}
    for key, i, _, value in rows:
        if key is not None:
            now[key] = now.get(key, 0.6) * 0.85 + value * 0.15
            assert abs(every[key, i] - now[key]) < 1e-9
    assert len(every) == sum(k is not None for k, *_ in rows)


def test_a_hot_key_is_spread(spark):
    rows = spark.range(1_000_000).select(F.lit("hot").alias("key"), "id", (F.col("id") * 7 % 11 / 11).alias("value"), (F.col("id") % 5).alias("w"))
    parts = ordered._ranged(rows.select("key", "id"), "key", ["id"]).groupBy("_part").count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 600_000
    want = 0.6
    for i in range(999_000, 1_000_000):
        want = want * 0.85 + (i * 7 % 11 / 11) * 0.15
    got = ordered.smoothed(rows, "key", ["id"], F.col("value")).first()
    assert got.n == 1_000_000 and abs(got.state - want) < 1e-12
    assert tuple(ordered.throttled(rows, "key", "id", ["id"], 180).first())[1:] == (5557, 1_000_000)
    names = F.array(*[F.lit(s) for s in ("validated", "tracking", "completed", "failed", "proposed")])
    assert review.replay(rows.withColumn("wanted", F.get(names, F.col("w").cast("int"))), "key", ["id"], "wanted").first().n_changes == 1_000_000


def test_runs_and_policy(spark):
    rows = spark.createDataFrame([("k", i, h) for i, h in enumerate([True, True] + [False] * 31 + [True])], "key string, id long, h boolean")
    out = ordered.runs(rows, "key", "id", F.col("h")).withColumn("p", ordered.miss_policy(F.col("miss_run"))).orderBy("id").collect()
    assert [r.hit_run for r in out[:2]] == [1, 2] and [r.miss_run for r in out[2:33]] == list(range(1, 32)) and out[-1].hit_run == 1
    assert [r.p for r in out] == ["observed"] * 2 + ["predicted"] * 6 + ["held"] * 24 + [None] + ["observed"]


def test_throttle(spark):
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate([0, 100, 180, 200, 400, 410])], "key string, id long, at long")
    assert tuple(ordered.throttled(rows, "key", "at", ["at", "id"]).first()) == ("k", 4, 6)


def test_bundles(spark, tmp_path):
    for name, text in (("a.json", '{"ok":true}'), ("b.json", "{}"), ("manifest.json", "[]"), ("c.txt", "x")):
        (tmp_path / name).write_text(text)
    listed = bundle_listing(spark, str(tmp_path))
    assert sorted(r.file_name for r in listed.collect()) == ["a.json", "b.json"]
    digest = listed.filter("file_name = 'a.json'").select(F.sha2("content", 256).alias("d")).first().d
    row = listed.filter("file_name = 'a.json'").select(catalog.verified(F.col("content"), F.lit(digest)).alias("same"), catalog.verified(F.col("content"), F.lit("0")).alias("other"), catalog.verified(F.col("content"), F.lit(None)).alias("none")).first()
    assert tuple(row) == (True, False, False)
    paths = spark.createDataFrame([("/d/a.json",), ("/dx/a.json",)], "path string")
    assert [r.path for r in paths.filter(catalog.under(F.col("path"), "/d")).collect()] == ["/d/a.json"]


def test_head_of_a_file_cut_inside_a_character(spark):
    texts = ["x" * 1023 + "é", "x" * 1022 + "é", "x" * 1023 + "\U0001f600", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", *[c.alias(n) for c, n in zip(catalog.head(F.col("text"), 10), ("head", "cut"))])
    found = [(r["head"], r["cut"]) for r in rows.orderBy("i").collect()]
    want = [(t.encode()[:1024].decode(errors="replace"), len(t.encode()) > 1024) if t is not None else (None, None) for t in texts]
    assert found == want


def test_legacy_store(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps({"scan_id": "s", "resolved_duplicates": "[[1, 2]]"}) + "\n" + json.dumps({"scan_id": "t", "resolved_duplicates": '[{"a": 3, "b": 4, "keep": 4}]'}) + "\n")
    found = {r.scan_id: [tuple(x) for x in r.resolved_duplicates] for r in legacy_store(spark, str(tmp_path / "old.json")).collect()}
    assert found == {"s": [(1, 2, 1)], "t": [(3, 4, 4)]}


def test_five_thousand_clusters_merge_in_little_memory():
    import time
    import tracemalloc

    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (1500, 24))
    c = clustering.Clusters(2.0)  # no vector joins a cluster, so each starts one
    for i in range(5000):
        v = centres[i % 1500] + rng.normal(0, 0.3, 24)
        c.add(i, 0.1, 0.1, 0.9, v / np.sqrt((v * v).sum()), 0.8, 1.0)
    tracemalloc.start()
    began = time.process_time()
    merges = c.merge()
    took, most = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 3000 < merges < 5000 and sum(c.seen) == 5000 and most < 100 << 20 and took < 60
    sims = c.centroids @ c.centroids.T
    np.fill_diagonal(sims, -1)
    assert sims.max() < clustering.STRONG
