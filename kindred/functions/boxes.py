"""Box geometry in source pixels; a box is four columns x1, y1, x2, y2."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import clamp


@dataclass(frozen=True)
class Box:
    """The columns of one box."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")])

    @classmethod
    def field(cls, row: Column) -> Box:
        return cls(row["x1"], row["y1"], row["x2"], row["y2"])

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2

    @property
    def longer(self) -> Column:
        return F.greatest(self.width, self.height)


def iou(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return F.when(both > 0, both / (a.width * a.height + b.width * b.height - both)).otherwise(0.0)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def proximity(far: Column, scale: Column) -> Column:
    """1 at no distance, 0 from `scale` (1 pixel at least) on."""
    return F.lit(1.0) - clamp(far / F.greatest(scale, F.lit(1.0)), 0, 1)


def candidate_rank(box: Box, confidence: Column, hint: tuple[Column, Column] | None) -> Column:
    if hint is None:
        return confidence
    return confidence + proximity(distance(box.cx, box.cy, *hint), box.longer * 4) * 0.35


def unletterbox(cx: Column, cy: Column, w: Column, h: Column, pad_x: Column, pad_y: Column, scale: Column, width: Column, height: Column) -> Box:
    """A detector's centre box, in the padded square, back in the frame: the start not below 0, the end not beyond the frame."""
    return Box(
        F.greatest((cx - w / 2 - pad_x) / scale, F.lit(0.0)), F.greatest((cy - h / 2 - pad_y) / scale, F.lit(0.0)),
        F.least((cx + w / 2 - pad_x) / scale, width), F.least((cy + h / 2 - pad_y) / scale, height),
    )


def downscale(width: Column, height: Column, most: int = 1920) -> tuple[Column, Column, Column, Column]:
    """Size at which detection runs, and the factors that its boxes are divided by; frames within `most` keep their size."""
    longest = F.greatest(width, height)
    large = longest > most
    w = F.when(large, F.greatest(F.round(width * (F.lit(float(most)) / longest)), F.lit(1.0))).otherwise(width).cast("long")
    h = F.when(large, F.greatest(F.round(height * (F.lit(float(most)) / longest)), F.lit(1.0))).otherwise(height).cast("long")
    return w, h, w / width, h / height


def face_crop(box: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """x, y, w, h of the upper part of a person box where a face is looked for, inside the frame, 1 pixel at least."""
    bw, bh = F.greatest(box.width, F.lit(1.0)), F.greatest(box.height, F.lit(1.0))
    head = clamp(F.lit(0.30) - (clamp(bw / bh, 0.2, 2.5) - 0.5) * 0.06, 0.18, 0.35)
    head = F.when(bh < 170, clamp(head + 0.04, 0.18, 0.35)).otherwise(head)
    w, h = F.greatest(bw * 0.72, F.lit(1.0)), F.greatest(bh * head, F.lit(1.0))
    x = F.least(F.greatest(box.cx - w / 2, F.lit(0.0)).cast("long"), width - 1)
    y = F.least(F.greatest(box.y1 + bh * 0.02, F.lit(0.0)).cast("long"), height - 1)
    return x, y, F.greatest(F.least(w.cast("long"), width - x), F.lit(1)), F.greatest(F.least(h.cast("long"), height - y), F.lit(1))


def body_crop(box: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """x, y, w, h of a person box without its top tenth."""
    x = F.floor(F.greatest(box.x1, F.lit(0.0)))
    y = F.floor(F.greatest(box.y1 + F.greatest(box.height, F.lit(1.0)) * 0.10, F.lit(0.0)))
    w = F.ceil(F.least(box.x2, width.cast("double"))) - x
    h = F.ceil(F.least(box.y2, height.cast("double"))) - y
    left = lambda n: F.greatest(n, F.lit(0))
    return x, y, F.least(F.greatest(w, F.lit(1)), left(width - x)), F.least(F.greatest(h, F.lit(1)), left(height - y))


def box_region(box: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """x, y, w, h of a box in whole pixels; all 0 where it starts outside the frame."""
    x, y = F.floor(F.greatest(box.x1, F.lit(0.0))), F.floor(F.greatest(box.y1, F.lit(0.0)))
    w = F.least(F.round(F.greatest(box.width, F.lit(1.0))).cast("long"), width - x)
    h = F.least(F.round(F.greatest(box.height, F.lit(1.0))).cast("long"), height - y)
    inside = (x < width) & (y < height)
    return tuple(F.when(inside, c).otherwise(F.lit(0)).cast("long") for c in (x, y, w, h))


def crop_window(cx: Column, cy: Column, half: Column, width: Column, height: Column, out_w: float = 1080.0, aspect: float = 0.5625):
    """x, y, w, h of the 9:16 window around a camera, whole pixels inside the frame."""
    h = F.least(F.least(F.greatest(half * 2.5, F.lit(out_w)), width.cast("double")) / aspect, height.cast("double"))
    w = h * aspect
    x = F.least(F.greatest(cx - w / 2, F.lit(0.0)), F.greatest(width - w, F.lit(0.0))).cast("long")
    y = F.least(F.greatest(cy - h / 2, F.lit(0.0)), F.greatest(height - h, F.lit(0.0))).cast("long")
    return x, y, F.least(w.cast("long"), width - x), F.least(h.cast("long"), height - y)


def letterbox(width: Column, height: Column, out_w: int = 1080, out_h: int = 1920):
    """Scaled size, and offsets of the picture in the output."""
    aspect = width / height
    wide = aspect > out_w / out_h
    w = F.greatest(F.when(wide, F.lit(out_w)).otherwise((aspect * out_h).cast("long")), F.lit(1)).cast("long")
    h = F.greatest(F.when(wide, (F.lit(float(out_w)) / aspect).cast("long")).otherwise(F.lit(out_h)), F.lit(1)).cast("long")
    return w, h, F.floor((F.lit(out_w) - w) / 2), F.floor((F.lit(out_h) - h) / 2)


def fit_box(width: Column, height: Column, max_w: float, max_h: float, least: int = 44) -> tuple[Column, Column]:
    """Preview size that keeps the aspect, no side below `least`; the whole space for a picture without a size."""
    scale = F.least(F.lit(float(max_w)) / width, F.lit(float(max_h)) / height)
    none = (width <= 0) | (height <= 0)
    side = lambda n, most: F.when(none, F.lit(int(most))).otherwise(F.greatest(F.lit(least), F.floor(n * scale + 0.5))).cast("long")
    return side(width, max_w), side(height, max_h)
