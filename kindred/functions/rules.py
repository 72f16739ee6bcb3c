"""Small text and number rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("proposed", "validated", "tracking", "completed", "failed")
#: Which status may follow which.
TRANSITIONS = (
    ("proposed", "validated"), ("validated", "proposed"), ("validated", "tracking"), ("tracking", "completed"), ("tracking", "failed"),
    ("proposed", "failed"), ("validated", "failed"), ("completed", "failed"), ("failed", "proposed"),
)


def known_status(text: Column) -> Column:
    return F.when(text.isin(*STATUSES), text).otherwise("proposed")


def can_follow(old: Column, new: Column) -> Column:
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    return (old == new) | F.array_contains(allowed, F.concat(old, F.lit(">"), new))


def guarded(old: Column, new: Column) -> Column:
    """The new status where it may follow the old one, else the old one."""
    return F.when(can_follow(old, new), new).otherwise(old)


def mode_of(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("quality", "hq"), "quality").when(t.isin("balanced", "balance", "normal"), "balanced").otherwise("fast")


def encoder_settings(mode: Column) -> tuple[Column, Column]:
    """Preset and quality factor of the software encoder for a normalised mode; the values are fixed."""
    return (F.when(mode == "quality", "medium").when(mode == "balanced", "veryfast").otherwise("ultrafast"),
            F.when(mode == "quality", 18).when(mode == "balanced", 20).otherwise(23))


def frame_count(nb: Column, seconds: Column, whole_seconds: Column, fps: Column) -> Column:
    """Frames by the first source that knows: the count, the stream's duration, the file's duration, else 0."""
    by = lambda s: F.when((s > 0) & (fps > 0), F.floor(s * fps + 0.5).cast("long"))
    return F.coalesce(F.when(nb > 0, nb), by(seconds), by(whole_seconds), F.lit(0).cast("long"))


def sample_estimate(frames: Column, stride: int, most: int) -> Column:
    return F.when(frames == 0, most).otherwise(F.least(F.greatest(F.floor(frames / stride), F.lit(1)), F.lit(most))).cast("long")


def fraction(done: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(F.least(done / total, F.lit(1.0)))


def eta_seconds(elapsed: Column, ratio: Column) -> Column:
    """Whole seconds left; null before any progress and at the end."""
    return F.when((ratio > 0) & (ratio < 1), F.floor(elapsed * (1 - ratio) / ratio + 0.5).cast("long"))


def duration_text(seconds: Column) -> Column:
    mins = F.floor(seconds / 60)
    text = lambda big, b, small, s: F.when(small == 0, F.concat(big.cast("string"), F.lit(b))).otherwise(F.concat(big.cast("string"), F.lit(b + " "), small.cast("string"), F.lit(s)))
    return (
        F.when(seconds.isNull(), "estimating...").when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(mins < 60, text(mins, "m", seconds % 60, "s")).otherwise(text(F.floor(mins / 60), "h", mins % 60, "m"))
    )


def candidate_confidence(n: Column, score: Column, similarity: Column, presence: Column, thumbnail: Column) -> Column:
    raw = F.least(n * 0.08, F.lit(0.44)) + 0.36 + score * 0.16 + similarity * 0.16 + presence * 0.10 + thumbnail * 0.12
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(0.995))


def thumbnail_quality(edge: Column, confidence: Column, similarity: Column, presence: Column) -> Column:
    part = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return part(part(edge / 92) * 0.40 + part(confidence) * 0.20 + part(similarity) * 0.16 + part(presence) * 0.24)


def body_score(similarity: Column) -> Column:
    return F.coalesce(F.least(F.greatest((similarity + 1) * 0.5, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def media_kind(path: Column) -> Column:
    """video or image, by the extension in any case."""
    extension = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(extension.isin("mp4", "mov", "mkv", "avi", "webm", "ts", "flv"), "video").otherwise("image")


def data_url(content: Column, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(content), "\r\n", ""))  # base64() breaks lines


def thumbnail_size(width: Column, height: Column, most: int = 280) -> tuple[Column, Column]:
    """Size with no side above `most`, never enlarged, a pixel at least."""
    scale = F.least(F.lit(float(most)) / width, F.lit(float(most)) / height, F.lit(1.0))
    return tuple(F.greatest(F.floor(side * scale + 0.5), F.lit(1)).cast("long") for side in (width, height))
