"""Vectors against galleries, and scored pairs of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import distance
from ..functions.vectors import clamp, dot, unit_or_empty
from .search import GALLERY_BYTES, best_matches, distinct_vectors

def best_in_gallery(rows: DataFrame, gallery: DataFrame, key: str, out: str, same_length: bool = False, embedding: str = "embedding", gallery_bytes: int = GALLERY_BYTES) -> DataFrame:
    """`rows` with the largest finite cosine against any gallery vector; null for an empty gallery.

    With same_length only vectors of equal length count and the result is clamped to [-1, 1]. Gallery vectors with a null or
    non-finite component are left out.
    """
    found = best_matches(rows, {"_best": distinct_vectors(gallery, embedding)}, key, embedding, same_length, gallery_bytes)
    score = F.col("_best.score")
    return found.select(*rows.columns, (F.when(score.isNotNull(), clamp(score, -1, 1)) if same_length else score).alias(out))


def target_margin(rows: DataFrame, targets: DataFrame, negatives: DataFrame, key: str, gallery_bytes: int = GALLERY_BYTES) -> DataFrame:
    """similarity to the targets, to the negatives (-1 without any), and their difference; without a finite similarity, no row."""
    of = {"_target": distinct_vectors(targets, "embedding"), "_negative": distinct_vectors(negatives, "embedding")}
    out = best_matches(rows, of, key, "embedding", gallery_bytes=gallery_bytes).filter("_target is not null")
    out = out.select(*rows.columns, F.col("_target.score").alias("similarity"), F.coalesce("_negative.score", F.lit(-1.0)).alias("impostor_similarity"))
    return out.withColumn("margin", F.col("similarity") - F.col("impostor_similarity"))


def as_targets(rows: DataFrame, selected: int, aliases: list[int]) -> DataFrame:
    """Each candidate's role: target for the selected id and those merged into it, else negative."""
    return rows.withColumn("role", F.when(F.col("id").isin(selected, *aliases), "target").otherwise("negative"))


def body_gallery(rows: DataFrame, of: str = "scan_id", others: int = 2) -> DataFrame:
    """Per scan the selected candidate (`selected` is true) and the `others` least similar ones of equal length, with similarities."""
    units = rows.withColumn("_u", unit_or_empty(F.col("embedding")))
    chosen = units.filter(F.col("selected") & (F.size("_u") > 0)).select(of, F.col("id").alias("target_id"), F.col("_u").alias("_t"))
    rest = units.filter(~F.col("selected")).join(chosen, of).filter(F.size("embedding") == F.size("_t"))
    scored = rest.select(of, "target_id", "id", dot(F.col("_t"), F.col("_u")).alias("similarity"))
    least = Window.partitionBy(of).orderBy("similarity", "id")
    picked = scored.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= others)
    own = chosen.select(of, "target_id", F.col("target_id").alias("id"), F.lit(1.0).alias("similarity"), F.lit(0).alias("place"))
    return own.unionByName(picked)


def nearest(rows: DataFrame, centroids: DataFrame, key: str, gallery_bytes: int = GALLERY_BYTES) -> DataFrame:
    """The centroid of largest cosine for each row, the smallest id of equal ones; none without centroids."""
    found = best_matches(rows.select(key, "embedding"), {"_best": distinct_vectors(centroids, "embedding", "id")}, key, gallery_bytes=gallery_bytes)
    return found.filter("_best is not null").select(key, F.col("_best.id").alias("nearest_id"), F.col("_best.score").alias("similarity"))


def overlap(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """Shared frames of two spans, ends included, by the shorter span."""
    shared = F.least(a_last, b_last) - F.greatest(a_first, b_first) + 1
    shorter = F.least(F.greatest(a_last - a_first, F.lit(0)) + 1, F.greatest(b_last - b_first, F.lit(0)) + 1)
    return F.when(shared > 0, clamp(shared / shorter, 0, 1)).otherwise(0.0)


def anchor_similarity(far: Column) -> Column:
    return F.lit(1.0) - clamp(far, 0, 1)


def duplicate_score(a: str, b: str, least_cosine: float = 0.70, most_far: float = 0.28, most_gap: float = 0.30) -> Column:
    """Score of two candidates' columns (prefixes a and b); 0 for unlike vectors or far anchors."""
    x = lambda p, c: F.col(f"{p}{c}")
    cosine = clamp(dot(x(a, "embedding"), x(b, "embedding")), 0, 1)
    far = distance(x(a, "anchor_x"), x(a, "anchor_y"), x(b, "anchor_x"), x(b, "anchor_y"))
    span = overlap(x(a, "first_frame"), x(a, "last_frame"), x(b, "first_frame"), x(b, "last_frame"))
    near = clamp(F.lit(1.0) - F.abs(x(a, "confidence") - x(b, "confidence")) / most_gap, 0, 1)
    score = clamp(cosine * 0.78 + anchor_similarity(far) * 0.10 + span * 0.08 + near * 0.04, 0, 1)
    return F.when((cosine < least_cosine) | (far > most_far), 0.0).otherwise(score)


def truncated(rows: DataFrame, most: int, within: str = "scan_id") -> DataFrame:
    """The best `most` candidates of each scan: by confidence, then observations, then the smaller id."""
    best = Window.partitionBy(within).orderBy(F.desc("confidence"), F.desc("observations"), "id")
    return rows.withColumn("_rk", F.row_number().over(best)).filter(F.col("_rk") <= most).drop("_rk")


def scored_pairs(rows: DataFrame, score, least: float, within: str = "scan_id") -> DataFrame:
    """Pairs a < b of one scan whose score reaches `least`.

    `rows` are the candidates of a report, which has few in each scan (see `truncated`), so pairs stay in proportion to scans.
    """
    left = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    right = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    pairs = left.join(right, (F.col(f"a_{within}") == F.col(f"b_{within}")) & (F.col("a_id") < F.col("b_id")))
    return pairs.withColumn("similarity", score).filter(F.col("similarity") >= least)
