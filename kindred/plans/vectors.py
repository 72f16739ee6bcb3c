"""Queries over embeddings, galleries and clusters.

The stand-in vectors have no pairs near the production thresholds, so thresholds are parameters and lower here.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.boxes import distance
from ..functions.rules import candidate_confidence, mode_of
from ..functions.vectors import dot, unit, unit_or_empty
from ..operators import clustering, galleries, states
from ..sources import candidates, cluster_input, sessions
from ._views import DOT, Plans, clamp_sql

P = Plans()
_COS = DOT.format(a="a.embedding", b="b.embedding")


def r6(column, name):
    return F.round(column, 6).alias(name)


@P.add("vec1_unit", "SELECT id, round(sqrt(s) / greatest(sqrt(s), 1e-10::DOUBLE), 6) AS norm, round(f / greatest(sqrt(s), 1e-10::DOUBLE), 6) AS first FROM (SELECT id, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS s, embedding[1]::DOUBLE AS f FROM cand)")
def _(spark, d):
    rows = candidates(spark, d).select("id", unit(F.col("embedding")).alias("u"))
    return rows.select("id", r6(F.sqrt(dot(F.col("u"), F.col("u"))), "norm"), r6(F.col("u")[0], "first"))


@P.add("vec2_unit_or_empty", "SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE 64 END::BIGINT AS n FROM cand")
def _(spark, d):
    v = F.when(F.col("id") % 5 == 0, F.transform("embedding", lambda x: x * F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    return candidates(spark, d).select("id", F.size(unit_or_empty(v)).cast("long").alias("n"))


@P.add("vec3_cosine", "SELECT a.id, round(" + _COS + ", 6) AS cosine FROM cand a JOIN cand b ON b.id = a.id + 1")
def _(spark, d):
    rows = candidates(spark, d).select("id", "embedding")
    after = rows.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return rows.join(after, "id").select("id", r6(dot(F.col("embedding"), F.col("other")), "cosine"))


_MARGIN = "SELECT a.id, max(CASE WHEN b.label = 0 THEN " + _COS + " END) AS t, coalesce(max(CASE WHEN b.label = 1 THEN " + _COS + " END), -1) AS n FROM cand a, cand b WHERE b.label < 2 GROUP BY a.id"


def _galleries(rows):
    return rows.filter("label = 0").select("embedding"), rows.filter("label = 1").select("embedding")


@P.add("vec4_target_margin", f"SELECT id, round(t, 6) AS similarity, round(n, 6) AS impostor_similarity, round(t - n, 6) AS margin FROM ({_MARGIN})")
def _(spark, d):
    rows = candidates(spark, d).select("id", "label", "embedding")
    out = galleries.target_margin(rows, *_galleries(rows), "id")
    return out.select("id", *[r6(F.col(c), c) for c in ("similarity", "impostor_similarity", "margin")])


@P.add("srt7_observation_order", f"SELECT id, row_number() OVER (ORDER BY round(t, 9) DESC, round(t - n, 9) DESC, id)::INT AS place FROM ({_MARGIN}) ORDER BY place LIMIT 100")
def _(spark, d):
    rows = candidates(spark, d).select("id", "label", "embedding")
    out = galleries.target_margin(rows, *_galleries(rows), "id").orderBy(F.round("similarity", 9).desc(), F.round("margin", 9).desc(), "id").limit(100)
    w = Window.orderBy(F.round("similarity", 9).desc(), F.round("margin", 9).desc(), "id")  # over the 100 rows of the page
    return out.select("id", F.row_number().over(w).alias("place"))


@P.add("vec5_equal_length", "SELECT a.id, round(" + clamp_sql("max(" + _COS + ")", -1, 1) + ", 6) AS body_similarity FROM cand a, cand b WHERE b.label = 2 AND b.id % 2 = 1 GROUP BY a.id")
def _(spark, d):
    rows = candidates(spark, d).select("id", "label", "embedding")
    own = rows.filter("label = 2").select(F.when(F.col("id") % 2 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    return galleries.best_in_gallery(rows, own, "id", "body", same_length=True).select("id", r6(F.col("body"), "body_similarity"))


@P.add("pix5_annotated", "SELECT a.id, round(" + clamp_sql("max(" + _COS + ")", -1, 1) + ", 6) AS body_similarity FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY confidence DESC, id) AS rk FROM cand) WHERE rk <= 16) a, cand b WHERE b.label = 3 GROUP BY a.id")
def _(spark, d):
    rows = candidates(spark, d).select("id", "scan_id", "label", "confidence", "embedding")
    w = Window.partitionBy("scan_id").orderBy(F.desc("confidence"), "id")
    best = rows.withColumn("rk", F.row_number().over(w)).filter("rk <= 16")
    return galleries.best_in_gallery(best, rows.filter("label = 3").select("embedding"), "id", "body", same_length=True).select("id", r6(F.col("body"), "body_similarity"))


@P.add("jn5_gallery_max", "SELECT a.id, round(max(" + _COS + "), 6) AS best FROM cand a, cand b WHERE b.label = 4 GROUP BY a.id")
def _(spark, d):
    rows = candidates(spark, d).select("id", "label", "embedding")
    return galleries.best_in_gallery(rows, rows.filter("label = 4").select("embedding"), "id", "best").select("id", r6(F.col("best"), "best"))


_PICK = "SELECT t.scan_id, t.id AS target_id, b.id, " + DOT.format(a="t.embedding", b="b.embedding") + " / sqrt(" + DOT.format(a="t.embedding", b="t.embedding") + ") / sqrt(" + DOT.format(a="b.embedding", b="b.embedding") + ") AS s FROM (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY id) = 1) t JOIN cand b ON b.scan_id = t.scan_id AND b.id <> t.id"


@P.add("vec6_body_gallery", f"SELECT scan_id, target_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY s, id)::INT AS place FROM ({_PICK})) WHERE place <= 2 UNION ALL SELECT scan_id, min(id), min(id), 0 FROM cand GROUP BY scan_id")
def _(spark, d):
    rows = candidates(spark, d).select("scan_id", "id", "embedding")
    first = rows.groupBy("scan_id").agg(F.min("id").alias("_first"))
    marked = rows.join(first, "scan_id").withColumn("selected", F.col("id") == F.col("_first"))
    return galleries.body_gallery(marked).select("scan_id", "target_id", "id", "place")


@P.add("srt12_two_least_similar", f"SELECT scan_id, id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY s, id) AS place FROM ({_PICK})) WHERE place <= 2")
def _(spark, d):
    rows = candidates(spark, d).select("scan_id", "id", "embedding")
    first = rows.groupBy("scan_id").agg(F.min("id").alias("_first"))
    marked = rows.join(first, "scan_id").withColumn("selected", F.col("id") == F.col("_first"))
    return galleries.body_gallery(marked).filter("place > 0").select("scan_id", "id", r6(F.col("similarity"), "similarity"))


@P.add("jn6_nearest_centroid", "SELECT id, nearest_id, round(s, 6) AS similarity FROM (SELECT a.id, b.id AS nearest_id, " + _COS + " AS s FROM cand a, cand b WHERE b.id < 10) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, nearest_id) = 1")
def _(spark, d):
    rows = candidates(spark, d).select("id", "embedding")
    return galleries.nearest(rows, rows.filter("id < 10"), "id").select("id", "nearest_id", r6(F.col("similarity"), "similarity"))


KEPT = 28  # candidates of a scan in the quality mode
_BEST = f"(SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY confidence DESC, observations DESC, id) <= {KEPT})"
_PAIRS = f"{_BEST} a JOIN {_BEST} b ON a.scan_id = b.scan_id AND a.id < b.id"


@P.add("jn4_similar_pairs", "SELECT a.scan_id, a.id AS a, b.id AS b, round(" + _COS + f", 6) AS similarity FROM {_PAIRS} WHERE " + _COS + " >= 0.3")
def _(spark, d):
    rows = galleries.truncated(candidates(spark, d), KEPT).select("scan_id", "id", "embedding")
    pairs = galleries.scored_pairs(rows, dot(F.col("a_embedding"), F.col("b_embedding")), 0.3)
    return pairs.select(F.col("a_scan_id").alias("scan_id"), F.col("a_id").alias("a"), F.col("b_id").alias("b"), r6(F.col("similarity"), "similarity"))


_FAR = "sqrt(power(a.anchor_x - b.anchor_x, 2) + power(a.anchor_y - b.anchor_y, 2))"
_SHARED = "(least(a.last_frame, b.last_frame) - greatest(a.first_frame, b.first_frame) + 1)"
_OVERLAP = f"(CASE WHEN {_SHARED} > 0 THEN " + clamp_sql(f"{_SHARED}::DOUBLE / least(a.last_frame - a.first_frame + 1, b.last_frame - b.first_frame + 1)") + " ELSE 0::DOUBLE END)"
_NEAR = clamp_sql("1 - abs(a.confidence - b.confidence) / 0.30::DOUBLE")
_DUP = f"(CASE WHEN {clamp_sql(_COS)} < 0.1 OR {_FAR} > 0.28 THEN 0::DOUBLE ELSE {clamp_sql(f'{clamp_sql(_COS)} * 0.78::DOUBLE + (1 - {clamp_sql(_FAR)}) * 0.10::DOUBLE + {_OVERLAP} * 0.08::DOUBLE + {_NEAR} * 0.04::DOUBLE')} END)"


def _pairs(spark, d, score, least):
    rows = galleries.truncated(candidates(spark, d), KEPT).select("scan_id", "id", "embedding", "anchor_x", "anchor_y", "first_frame", "last_frame", "confidence")
    return galleries.scored_pairs(rows, score, least).withColumnsRenamed({"a_scan_id": "scan_id", "a_id": "a", "b_id": "b"})


@P.add("clu4_duplicate_score", f"SELECT a.scan_id, a.id AS a, b.id AS b, round({_DUP}, 6) AS similarity FROM {_PAIRS} WHERE {_DUP} >= 0.25")
def _(spark, d):
    return _pairs(spark, d, galleries.duplicate_score("a_", "b_", least_cosine=0.1), 0.25).select("scan_id", "a", "b", r6(F.col("similarity"), "similarity"))


@P.add("srt9_top_duplicates", f"SELECT a.id AS a, b.id AS b, round({_DUP}, 6) AS similarity FROM {_PAIRS} ORDER BY round({_DUP}, 9) DESC, a.id, b.id LIMIT 36")
def _(spark, d):
    out = _pairs(spark, d, galleries.duplicate_score("a_", "b_", least_cosine=0.1), 0.0)
    return out.orderBy(F.round("similarity", 9).desc(), "a", "b").limit(36).select("a", "b", r6(F.col("similarity"), "similarity"))


@P.add("jn11_span_overlap", f"SELECT a.id AS a, b.id AS b, round({_OVERLAP}, 6) AS overlap FROM {_PAIRS} WHERE {_OVERLAP} > 0")
def _(spark, d):
    score = galleries.overlap(*[F.col(c) for c in ("a_first_frame", "a_last_frame", "b_first_frame", "b_last_frame")])
    return _pairs(spark, d, score, 1e-12).select("a", "b", r6(F.col("similarity"), "overlap"))


@P.add("clu5_anchor_similarity", f"SELECT a.id AS a, b.id AS b, round(1 - {clamp_sql(_FAR)}, 6) AS similarity FROM {_PAIRS}")
def _(spark, d):
    far = distance(F.col("a_anchor_x"), F.col("a_anchor_y"), F.col("b_anchor_x"), F.col("b_anchor_y"))
    return _pairs(spark, d, galleries.anchor_similarity(far), 0.0).select("a", "b", r6(F.col("similarity"), "similarity"))


@P.add("clu6_group_anchor_distance", """WITH g AS (SELECT label, avg(anchor_x) AS x, avg(anchor_y) AS y FROM cand GROUP BY label) SELECT a.label AS a, b.label AS b, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) AS far FROM g a JOIN g b ON b.label = a.label + 1""")
def _(spark, d):
    g = candidates(spark, d).groupBy("label").agg(F.avg("anchor_x").alias("x"), F.avg("anchor_y").alias("y"))
    other = g.select((F.col("label") - 1).alias("label"), F.col("label").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return g.join(other, "label").select(F.col("label").alias("a"), "b", r6(distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")), "far"))


_SUMS = """SELECT label, count(*)::BIGINT AS n, sum(confidence) AS confidence_sum, sum(face_presence) AS presence_sum, sum(anchor_x) AS x, sum(anchor_y) AS y, min(first_frame) AS first_frame, max(last_frame) AS last_frame,
  count(*) FILTER (WHERE face_presence >= 0.58)::BIGINT AS strong, max(thumbnail_score) AS thumbnail FROM cand GROUP BY label"""


def _sums(spark, d):
    return candidates(spark, d).groupBy("label").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("confidence_sum"), F.sum("face_presence").alias("presence_sum"), F.sum("anchor_x").alias("x"), F.sum("anchor_y").alias("y"),
        F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.count_if(F.expr("face_presence >= 0.58D")).alias("strong"), F.max("thumbnail_score").alias("thumbnail"))


_CELLS = "SELECT scan_id, i, sum(confidence * embedding[i]::DOUBLE) AS s FROM cand, (SELECT unnest(range(1, 65)) AS i) GROUP BY scan_id, i"


@P.add("agg7_merged_states", f"""SELECT scan_id, n, round(weight, 6) AS weight, round(s1, 6) AS s1, round(s64, 6) AS s64, round(s1 / norm, 6) AS c1, best FROM (
  SELECT scan_id, count(*)::BIGINT AS n, sum(confidence) AS weight, arg_max(id, (thumbnail_score, -id)) AS best FROM cand GROUP BY scan_id)
  JOIN (SELECT scan_id, sum(CASE WHEN i = 1 THEN s END) AS s1, sum(CASE WHEN i = 64 THEN s END) AS s64, sqrt(sum(s * s)) AS norm FROM ({_CELLS}) GROUP BY scan_id) USING (scan_id)""")
def _(spark, d):
    # states of quarters of each scan, merged to scans
    rows = candidates(spark, d).withColumn("part", F.concat_ws("/", "scan_id", (F.col("id") % 4).cast("string")))
    parts = states.group_states(rows, "part", "embedding", "confidence", "thumbnail_score", "id")
    out = states.merged_states(parts.withColumn("scan_id", F.split("part", "/")[0]), "scan_id").withColumn("c", states.centroid())
    return out.select("scan_id", "n", r6(F.col("weight"), "weight"), r6(F.col("sums")[0], "s1"), r6(F.col("sums")[63], "s64"), r6(F.col("c")[0], "c1"), F.col("best.payload").alias("best"))


@P.add("agg3_cluster_sums", f"SELECT label, n, round(confidence_sum, 6) AS confidence_sum, round(presence_sum, 6) AS presence_sum, first_frame, last_frame, strong FROM ({_SUMS})".replace(">= 0.58)", ">= 0.58::DOUBLE)"))
def _(spark, d):
    return _sums(spark, d).select("label", "n", r6(F.col("confidence_sum"), "confidence_sum"), r6(F.col("presence_sum"), "presence_sum"), "first_frame", "last_frame", "strong")


@P.add("agg4_means", f"SELECT label, round(confidence_sum / n, 6) AS confidence, round(presence_sum / n, 6) AS presence, round(x / n, 6) AS anchor_x, round(y / n, 6) AS anchor_y FROM ({_SUMS})")
def _(spark, d):
    n = F.col("n")
    return _sums(spark, d).select("label", r6(F.col("confidence_sum") / n, "confidence"), r6(F.col("presence_sum") / n, "presence"), r6(F.col("x") / n, "anchor_x"), r6(F.col("y") / n, "anchor_y"))


@P.add("agg5_best_thumbnail", "SELECT label, id, round(thumbnail_score, 6) AS quality FROM cand QUALIFY row_number() OVER (PARTITION BY label ORDER BY thumbnail_score DESC, id) = 1")
def _(spark, d):
    best = candidates(spark, d).groupBy("label").agg(F.max_by("id", F.struct("thumbnail_score", -F.col("id"))).alias("id"), F.max("thumbnail_score").alias("q"))
    return best.select("label", "id", r6(F.col("q"), "quality"))


@P.add("agg12_counters", "SELECT count(*)::BIGINT AS seen, count(*) FILTER (WHERE face_presence < 0.445)::BIGINT AS rejected, count(DISTINCT label)::BIGINT AS scans FROM cand")
def _(spark, d):
    return candidates(spark, d).agg(F.count("*").alias("seen"), F.count_if(F.expr("face_presence < 0.445D")).alias("rejected"), F.countDistinct("label").alias("scans"))


@P.add("agg14_any_low", "SELECT label, bool_or(confidence < 0.595) AS any_low, bool_and(confidence < 2) AS all_bounded FROM cand GROUP BY label")
def _(spark, d):
    return candidates(spark, d).groupBy("label").agg(F.bool_or(F.expr("confidence < 0.595D")).alias("any_low"), F.bool_and(F.expr("confidence < 2D")).alias("all_bounded"))


@P.add("fil8_presence_gate", "SELECT id FROM cand WHERE face_presence >= 0.445")
def _(spark, d):
    return candidates(spark, d).filter("face_presence >= 0.445D").select("id")


@P.add("fil11_quality_gates", "SELECT id FROM cand WHERE observations >= 3 AND confidence >= 0.555 AND thumbnail_score >= 0.545 AND face_presence >= 0.445 AND observations - 2 >= 1")
def _(spark, d):
    return candidates(spark, d).filter("observations >= 3").filter("confidence >= 0.555D").filter("thumbnail_score >= 0.545D").filter("face_presence >= 0.445D").filter("observations - 2 >= greatest(3 div 2, 1)").select("id")


_CONF = "least(greatest(0.36::DOUBLE + least(observations * 0.08::DOUBLE, 0.44::DOUBLE) + confidence * 0.16::DOUBLE + 0.9::DOUBLE * 0.16::DOUBLE + face_presence * 0.10::DOUBLE + thumbnail_score * 0.12::DOUBLE, 0::DOUBLE), 0.995::DOUBLE)"


def _confidence():
    return candidate_confidence(F.col("observations"), F.col("confidence"), F.lit(0.9), F.col("face_presence"), F.col("thumbnail_score"))


@P.add("clu3_confidence", f"SELECT id, round({_CONF}, 6) AS confidence FROM cand")
def _(spark, d):
    return candidates(spark, d).select("id", r6(_confidence(), "confidence"))


@P.add("srt5_candidate_order", f"SELECT id, round({_CONF}, 6) AS confidence FROM cand ORDER BY round({_CONF}, 9) DESC, observations DESC, id LIMIT 18")
def _(spark, d):
    rows = candidates(spark, d).withColumn("c", _confidence())
    return rows.orderBy(F.round("c", 9).desc(), F.desc("observations"), "id").limit(18).select("id", r6(F.col("c"), "confidence"))


@P.add("srt6_tightened", "SELECT id, observations FROM cand ORDER BY observations DESC, round(confidence, 9) DESC, id LIMIT 7")
def _(spark, d):
    expected = 5
    return candidates(spark, d).orderBy(F.desc("observations"), F.round("confidence", 9).desc(), "id").limit(expected + 2).select("id", "observations")


@P.add("clu9_presets", """SELECT scan_id, stride, samples, gate, candidates, loose_stride, loose_samples, loose_gate, loose_candidates FROM ses JOIN (VALUES (0, 18, 520, 0.79::DOUBLE, 12, 9, 1040, 0.77::DOUBLE, 22), (1, 12, 900, 0.77::DOUBLE, 18, 6, 1800, 0.75::DOUBLE, 28), (2, 8, 1400, 0.75::DOUBLE, 28, 4, 2800, 0.73::DOUBLE, 38))
  t(m, stride, samples, gate, candidates, loose_stride, loose_samples, loose_gate, loose_candidates) ON user_id % 3 = m""")
def _(spark, d):
    asked = F.element_at(F.array(F.lit("?"), F.lit("Balance"), F.lit("HQ")), (F.col("user_id") % 3 + 1).cast("int"))
    rows = sessions(spark, d).select("scan_id", mode_of(asked).alias("mode")).join(F.broadcast(clustering.presets(spark)), "mode")  # three rows
    short = {"stride": "sample_stride", "samples": "max_sampled_frames", "gate": "cluster_similarity", "candidates": "max_candidates"}
    return rows.select("scan_id", *[F.round(F.col(p + n), 6).alias(p + s) if s == "gate" else F.col(p + n).alias(p + s) for p in ("", "loose_") for s, n in short.items()])


@P.add("clu10_needs_review", "SELECT label, count(*) <> 50 OR bool_or(confidence < 0.55) AS needs_review FROM cand GROUP BY label")
def _(spark, d):
    return candidates(spark, d).groupBy("label").agg((F.count("*") != 50).alias("a"), F.bool_or(F.expr("confidence < 0.55D")).alias("b")).select("label", (F.col("a") | F.col("b")).alias("needs_review"))


@P.add("jn10_roles", "SELECT id, CASE WHEN id IN (3, 8, 21) THEN 'target' ELSE 'negative' END AS role FROM cand")
def _(spark, d):
    return galleries.as_targets(candidates(spark, d).select("id"), 3, [8, 21])


LOOSE = clustering.Config(cluster_similarity=0.30, duplicate_similarity=0.2, min_embedding_similarity=0.2, min_thumbnail_quality=0.4, min_face_presence=0.3, max_candidates=50, least_duplicate_cosine=0.1)


@P.add("clu1_leader_labels")
def _(spark, d):
    return clustering.leader_labels(cluster_input(spark, d), 0.30)


@P.add("agg6_cluster_sizes")
def _(spark, d):
    labels = clustering.leader_labels(cluster_input(spark, d), 0.30)
    return labels.groupBy("scan_id", "cluster").agg(F.count("*").alias("n"), r6(F.avg("similarity"), "similarity"))


@P.add("clu1_rows_conserved", "SELECT scan_id, count(*)::BIGINT AS n FROM cand GROUP BY scan_id")
def _(spark, d):
    found = clustering.discover(cluster_input(spark, d), LOOSE)
    return found.groupBy("scan_id").agg(F.max("all_observations").alias("n"))


@P.add("clu2_merged_candidates")
def _(spark, d):
    return clustering.discover(cluster_input(spark, d), LOOSE)


@P.add("clu8_adaptive_scan")
def _(spark, d):
    return clustering.discover_adaptively(cluster_input(spark, d), "quality", 3)


@P.add("srt9_report_duplicates")
def _(spark, d):
    found = clustering.discover(cluster_input(spark, d), LOOSE)
    return found.select("scan_id", F.col("id").alias("candidate"), F.explode("duplicates").alias("pair")).filter("pair.a = candidate").select("scan_id", "pair.*")
