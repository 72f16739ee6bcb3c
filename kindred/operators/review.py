"""Review of a scan's candidates: duplicates, blockers, lifecycle. All functions take the rows of any number of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import names_folder, parent, resolved
from ..functions.rules import STATUSES, TRANSITIONS, guarded
from .ordered import finite, folded


def pair_key(a: str = "a", b: str = "b") -> tuple:
    return F.least(a, b), F.greatest(a, b)


def normalised_resolutions(rows: DataFrame, scan: str = "scan_id", position: str = "pos") -> DataFrame:
    """The first valid resolution of each pair, with the id to drop. Rows whose `keep` is not of the pair are left out."""
    low, high = pair_key()
    valid = rows.filter((F.col("keep") == F.col("a")) | (F.col("keep") == F.col("b"))).select(scan, low.alias("a"), high.alias("b"), "keep", position)
    first = Window.partitionBy(scan, "a", "b").orderBy(position)
    kept = valid.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
    return kept.select(scan, "a", "b", "keep", F.when(F.col("keep") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("drop"))


def invalid_resolutions(rows: DataFrame, scan: str = "scan_id") -> DataFrame:
    bad = (F.col("keep") != F.col("a")) & (F.col("keep") != F.col("b"))
    return rows.groupBy(scan).agg(F.count_if(bad).alias("invalid"))


def excluded_ids(user: DataFrame, resolved: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Ids that the user excluded, and those that resolutions drop."""
    return user.select(scan, "id").unionByName(resolved.select(scan, F.col("drop").alias("id"))).distinct()


def active(candidates: DataFrame, excluded: DataFrame, scan: str = "scan_id") -> DataFrame:
    return candidates.join(excluded, [scan, "id"], "left_anti")


def unresolved_pairs(pairs: DataFrame, excluded: DataFrame, resolved: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Duplicate pairs without a resolution, neither of whose ids is excluded."""
    low, high = pair_key()
    keyed = pairs.withColumn("_lo", low).withColumn("_hi", high)
    done = resolved.select(scan, F.col("a").alias("_lo"), F.col("b").alias("_hi"))
    out = keyed.join(excluded.select(scan, F.col("id").alias("a")), [scan, "a"], "left_anti")
    out = out.join(excluded.select(scan, F.col("id").alias("b")), [scan, "b"], "left_anti")
    return out.join(done, [scan, "_lo", "_hi"], "left_anti").drop("_lo", "_hi")


def blockers(
    scans: DataFrame, candidates: DataFrame, pairs: DataFrame, resolutions: DataFrame, user_excluded: DataFrame, accepted: DataFrame, splits: DataFrame,
    scan: str = "scan_id",
) -> DataFrame:
    """What stands against each scan, in fixed order, and whether it is ready.

    `scans` has scan_id, expected_count and selected_id. A scan is ready if nothing stands against it.
    """
    resolved = normalised_resolutions(resolutions, scan)
    out_ids = excluded_ids(user_excluded, resolved, scan)
    rows = active(candidates, out_ids, scan)
    marked = rows.join(accepted.select(scan, "id", F.lit(True).alias("ok")), [scan, "id"], "left").join(splits.select(scan, "id", F.lit(True).alias("split")), [scan, "id"], "left")
    marked = marked.join(scans.select(scan, "selected_id"), scan)
    per = marked.groupBy(scan).agg(
        F.count("*").alias("active"), F.count_if((F.col("confidence") < 0.55) & F.col("ok").isNull()).alias("low"),
        F.count_if(F.col("split").isNotNull()).alias("splits"), F.count_if(F.col("id") == F.col("selected_id")).alias("chosen"),
    )
    open_pairs = unresolved_pairs(pairs, out_ids, resolved, scan).groupBy(scan).agg(F.count("*").alias("open"))
    joined = scans.join(per, scan, "left").join(open_pairs, scan, "left").join(invalid_resolutions(resolutions, scan), scan, "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("active", "low", "splits", "chosen", "open", "invalid")}
    text = lambda head, c: F.when(n[c] > 0, F.concat(F.lit(head), n[c].cast("string")))
    found = F.array_compact(F.array(
        text("invalid duplicate resolution entries: ", "invalid"),
        F.when(F.col("expected_count") != n["active"], F.concat(F.lit("member count mismatch: expected "), F.col("expected_count").cast("string"), F.lit(", active "), n["active"].cast("string"))),
        text("unresolved duplicate pairs: ", "open"),
        text("unconfirmed low-confidence identities: ", "low"),
        text("pending split review identities: ", "splits"),
        F.when(n["chosen"] == 0, "no valid selected target identity"),
    ))
    return joined.select(scan, n["active"].alias("active_count"), found.alias("blockers"), (F.size(found) == 0).alias("ready"))


def apply_review(sessions: DataFrame, reviews: DataFrame, threshold: float, now_ms: int, scan: str = "scan_id") -> DataFrame:
    """Sessions after their review: ready, the clamped threshold, the blockers, and the status where it may follow."""
    new = reviews.select(scan, F.col("ready").alias("_ready"), F.col("blockers").alias("last_blockers"))
    wanted = F.when(F.col("_ready"), "validated").otherwise("proposed")
    return sessions.join(new, scan).select(
        scan, F.col("_ready").alias("review_ready"), F.lit(min(max(threshold, 0.0), 1.0)).alias("validated_threshold"), "last_blockers",
        F.lit(now_ms).cast("long").alias("updated_at_ms"), guarded(F.col("status"), wanted).alias("status"),
    )


def transition_table(spark) -> DataFrame:
    """Every legal edge between statuses, without the identity."""
    return spark.createDataFrame(list(TRANSITIONS), "old string, new string")


def replay(changes: DataFrame, key: str, order: list[str], wanted: str, first: str = "proposed") -> DataFrame:
    """The status that each key ends in after its changes in order; illegal ones are ignored.

    A change is a map over the five statuses, so a key's changes are folded in pieces.
    """
    name = F.array(*[F.lit(s) for s in STATUSES])
    number = lambda s: F.array_position(name, s).cast("int") - 1
    step = F.array(*[number(guarded(F.lit(s), F.coalesce(F.col(wanted), F.lit("")))) for s in STATUSES])
    out = folded(changes, key, order, step, F.lit(STATUSES.index(first)), finite(len(STATUSES)))
    return out.select(key, F.get(name, F.col("state")).alias("status"), F.col("n").alias("n_changes"))


def rescan_applied(sessions: DataFrame, rescanned: DataFrame, now_ms: int) -> DataFrame:
    """Sessions whose rescan came back: splits and selection are cleared and review starts again."""
    hit = sessions.join(rescanned.select("scan_id"), "scan_id", "left_semi")
    none = F.lit(None)
    return hit.select(
        "scan_id", F.lit(False).alias("review_ready"), none.cast("long").alias("selected_identity_id"), none.cast("double").alias("validated_threshold"),
        guarded(F.col("status"), F.lit("proposed")).alias("status"), F.lit("split rescan complete: please validate again").alias("last_blocker"),
        F.lit(now_ms).cast("long").alias("updated_at_ms"),
    )


def rescan_event(rescanned: DataFrame, now_ms: int) -> DataFrame:
    return rescanned.select("scan_id", F.lit(now_ms).cast("long").alias("at_ms"), F.lit("split_rescan_processed").alias("action"), F.lit("candidates refreshed and review reset").alias("details"))


#: A fixed value: what is said where no body model is given or found.
NO_BODY_MODEL = "body reid model not found: expected models/osnet_x0_25_msmt17.onnx for identity-locked runs"
#: Columns of a run that name files.
RUN_FILES = ("video", "bias", "detector", "face_model", "body_model")


def preflight(runs: DataFrame, files: DataFrame, at: str = "/", files_bytes: int = 16 << 20) -> DataFrame:
    """run_id and problem: the first thing that keeps a run from starting, or null.

    `runs` has run_id, output, the columns of RUN_FILES, n_targets (vectors that are not empty), n_gallery, margin and has_default_body;
    `files` has each absolute path that exists once, and is_folder. Paths are compared as they resolve (from the folder `at`);
    problems show them as given. One join finds all of a run's paths; files are broadcast where their paths take at most
    `files_bytes`.
    """
    folder = parent(F.trim("output"))
    named = [(c, F.trim(c)) for c in RUN_FILES] + [("folder", folder)]
    wanted = runs.select("run_id", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), p.alias("as_given")) for r, p in named])).alias("w")).select("run_id", "w.*")
    wanted = wanted.filter(F.length("as_given") > 0).select("run_id", "role", resolved(F.col("as_given"), at).alias("path"), names_folder(F.col("as_given")).alias("_as_folder"))
    known = files.select("path", "is_folder")
    size = known.agg(F.sum(F.octet_length("path") + 16)).first()[0] or 0
    met = wanted.join(F.broadcast(known) if size <= files_bytes else known, "path").filter(F.col("is_folder") | ~F.col("_as_folder"))
    # 1 for a file, 2 for a folder, null for nothing
    state = met.groupBy("run_id").agg(*[F.max(F.when(F.col("role") == r, F.when(F.col("is_folder"), 2).otherwise(1))).alias(f"_{r}") for r in (*RUN_FILES, "folder")])
    rows = runs.join(state, "run_id", "left")
    no_file = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0)) != 1
    body, out = F.trim("body_model"), F.trim("output")
    checks = [
        (no_file("video"), F.concat(F.lit("input video not found: "), F.trim("video"))),
        ((F.col("n_targets") + F.col("n_gallery") == 0) & no_file("bias"), F.concat(F.lit("bias image not found: "), F.trim("bias"))),
        (F.col("margin").isNotNull() & (F.isnan("margin") | (F.abs("margin") == float("inf"))), F.lit("identity margin threshold must be finite")),
        ((F.length(body) > 0) & no_file("body_model"), F.concat(F.lit("body reid model not found: "), body)),
        ((F.length(body) == 0) & (F.col("n_gallery") > 0) & ~F.col("has_default_body"), F.lit(NO_BODY_MODEL)),
        (no_file("detector"), F.concat(F.lit("YOLO model not found: "), F.trim("detector"))),
        (no_file("face_model"), F.concat(F.lit("face model not found: "), F.trim("face_model"))),
        (F.length(out) == 0, F.lit("output path is empty")),
        (resolved(out, at) == resolved(F.trim("video"), at), F.lit("output path must be different from input video path")),
        (folder.isNull(), F.lit("output path has no parent directory")),
        (F.col("_folder").isNull(), F.concat(F.lit("output directory does not exist: "), folder)),
        (F.col("_folder") == 1, F.concat(F.lit("output parent is not a directory: "), folder)),
    ]
    return rows.select("run_id", F.coalesce(*[F.when(bad, text) for bad, text in checks]).alias("problem"))


def check_run(video: str, output: str, threshold: float, exists) -> None:
    """Raise ValueError for parameters that a render can't run with."""
    if not video.strip() or not exists(video):
        raise ValueError(f"input video does not exist: {video}")
    if not output.strip():
        raise ValueError("an output path is needed")
    if video == output:
        raise ValueError("output must differ from input")
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be within 0 and 1")
