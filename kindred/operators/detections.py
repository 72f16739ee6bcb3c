"""Boxes per frame: suppression, ranking, gating."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions.boxes import Box, candidate_rank, distance, iou, proximity
from ..functions.rules import body_score
from ..functions.vectors import clamp, finite

#: Pixels that are scored at once in a task (an image is never split).
PIXELS = 200_000


def best_per_frame(rows: DataFrame, n: int, score: Column, tie: str = "box_id", frame: str = "frame_index") -> DataFrame:
    """The n best rows of each frame, with their rank."""
    w = Window.partitionBy(frame).orderBy(score.desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def suppress(rows: DataFrame, most_iou: float = 0.45, frame: str = "frame_index") -> DataFrame:
    """Greedy non-maximum suppression within each frame: in order of confidence, boxes that overlap a kept one by more go.

    Boxes without a finite confidence are dropped. A frame's boxes are folded as one array, so a frame should hold
    few boxes (see best_per_frame).
    """
    box = F.struct((-F.col("confidence")).alias("k"), "box_id", "x1", "y1", "x2", "y2", "confidence")
    kind = "array<struct<k:double,box_id:int,x1:double,y1:double,x2:double,y2:double,confidence:double>>"
    grouped = rows.filter(finite(F.col("confidence"))).groupBy(frame).agg(F.array_sort(F.collect_list(box)).alias("all"))

    def keep(kept: Column, x: Column) -> Column:
        hidden = F.exists(kept, lambda y: iou(Box.field(y), Box.field(x)) > most_iou)
        return F.when(hidden, kept).otherwise(F.array_append(kept, x))

    kept = grouped.select(frame, F.explode(F.aggregate("all", F.array().cast(kind), keep)).alias("b"))
    return kept.select(frame, *[F.col(f"b.{c}").alias(c) for c in ("box_id", "x1", "y1", "x2", "y2", "confidence")])


def gate_by_hint(rows: DataFrame, hint: tuple[Column, Column], frame: str = "frame_index") -> DataFrame:
    """Boxes near the hint; in frames where none is, the 3 best by rank stay."""
    box = Box.of()
    far = distance(box.cx, box.cy, *hint)
    near = far <= clamp(F.greatest(box.longer, F.lit(1.0)) * 8, 140, 440)
    w = Window.partitionBy(frame)
    ranked = rows.withColumn("near", near).withColumn(
        "rank", F.row_number().over(w.orderBy(candidate_rank(box, F.col("confidence"), hint).desc(), F.col("box_id"))))
    marked = ranked.withColumn("any_near", F.bool_or("near").over(w))
    return marked.filter(F.col("near") | (~F.col("any_near") & (F.col("rank") <= 3)))


def observation_score(box: Box, hint: tuple[Column, Column], last: Box) -> Column:
    near = proximity(distance(box.cx, box.cy, *hint), box.longer * 8)
    return F.col("similarity") + F.col("margin") * 0.20 + near * 0.16 + clamp(iou(box, last), 0, 1) * 0.16 + body_score(F.col("body_similarity")) * 0.12


def support_score(box: Box, hint: tuple[Column, Column], last: Box) -> Column:
    return proximity(distance(box.cx, box.cy, *hint), box.longer * 6) * 0.35 + clamp(iou(last, box), 0, 1) * 0.65


def recovery_priority(box: Box, last: Box) -> Column:
    near = proximity(distance(box.cx, box.cy, last.cx, last.cy), last.longer * 6.5)
    return (
        F.col("similarity") * 0.55 + F.col("margin") * 0.15 + clamp(iou(box, last), 0, 1) * 0.16 + near * 0.10 + body_score(F.col("body_similarity")) * 0.04
    )


def score_gap(rows: DataFrame, score: Column, least: float = 0.04, frame: str = "frame_index") -> DataFrame:
    """Best and second-best score of each frame; a gap below `least`, or no second, is weak."""
    w = Window.partitionBy(frame).orderBy(score.desc(), F.col("box_id"))
    out = rows.select(frame, "box_id", score.alias("best"), F.lead(score).over(w).alias("second"), F.row_number().over(w).alias("rank")).filter("rank = 1").drop("rank")
    return out.withColumn("weak", F.coalesce(F.col("best") - F.col("second") < least, F.lit(True)))


def presence(grids: np.ndarray) -> np.ndarray:
    """Face presence of each grid of luma values (images x rows x columns), from 0 to 1; values that are NaN count for nothing.

    Texture, edges, left-right symmetry, weight of the edges in the centre, and contrast of the upper and lower third.
    """
    n, rows, cols = grids.shape

    def mean(x: np.ndarray) -> np.ndarray:
        x = x.reshape(n, -1)
        there = ~np.isnan(x)
        return np.where(there, x, 0.0).sum(axis=1) / np.maximum(there.sum(axis=1), 1)

    part = lambda x, low, wide: np.clip((x - low) / wide, 0, 1)
    edge = np.abs(grids[:, :-1, :-1] - grids[:, :-1, 1:]) + np.abs(grids[:, :-1, :-1] - grids[:, 1:, :-1])
    inner = np.nansum(edge[:, rows // 4 : rows * 3 // 4 + 1, cols // 4 : cols * 3 // 4 + 1], axis=(1, 2))
    edges = np.nansum(edge, axis=(1, 2))
    asym = mean(np.abs(grids - grids[:, :, ::-1])[:, :, : cols // 2])
    contrast = np.abs(mean(grids[:, : rows // 3]) - mean(grids[:, rows * 2 // 3 :]))
    sd = np.sqrt(mean((grids - mean(grids)[:, None, None]) ** 2))
    return np.clip(
        part(sd, 12, 38) * 0.24 + part(mean(edge), 7, 26) * 0.22 + np.clip(1 - asym / 58, 0, 1) * 0.20
        + part(inner / np.maximum(edges - inner, 1e-3), 0.75, 0.85) * 0.22 + part(contrast, 10, 42) * 0.12, 0, 1)


def presence_of_grids(images: DataFrame, image: str = "image", cols: str = "cols", luma: str = "luma") -> DataFrame:
    """Face presence (see `presence`) of each row's grid: an array of luma values, line by line, and the length of a line.

    Rows keep their place, so nothing is shuffled. Without luma, or where lines of `cols` don't fill the array, it is null.
    """
    ship(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, wide = batch.column(2), batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = column.flatten().to_numpy(zero_copy_only=False)
            starts, found = np.cumsum(sizes) - sizes, np.full(batch.num_rows, np.nan)
            fits = (wide > 0) & (sizes > 0) & (sizes % np.maximum(wide, 1) == 0)
            shapes = np.stack([sizes, wide], axis=1)
            for size, w in np.unique(shapes[fits], axis=0).tolist():
                at = np.flatnonzero(fits & (sizes == size) & (wide == w))
                step = max(1, PIXELS // size)
                for low in range(0, len(at), step):
                    some = at[low : low + step]
                    found[some] = presence(values[starts[some][:, None] + np.arange(size)[None]].reshape(len(some), size // w, w))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, mask=np.isnan(found))], names=[image, "presence"])

    rows = images.select(image, F.col(cols).cast("long"), F.col(luma).cast("array<double>"))
    return rows.mapInArrow(run, f"`{image}` {images.schema[image].dataType.simpleString()}, presence double")


def presence_score(luma: DataFrame, image: str = "image", row: str = "row", col: str = "col") -> DataFrame:
    """Face presence (see `presence`) of each image from its pixels (image, row, col, luma), numbered from 0.

    An image's pixels are brought together once, as one array; a pixel that is not there counts for nothing.
    """
    pixel = F.struct(F.col(row).cast("long").alias("r"), F.col(col).cast("long").alias("c"), F.col("luma").cast("double").alias("luma"))
    sizes = [(F.max(row) + 1).cast("long").alias("_rows"), (F.max(col) + 1).cast("long").alias("cols")]
    grids = luma.groupBy(image).agg(*sizes, F.array_sort(F.collect_list(pixel)).alias("_p"))
    whole = F.size("_p") == F.col("_rows") * F.col("cols")  # sorted, they are the lines
    at = F.map_from_arrays(F.transform("_p", lambda p: p["r"] * F.col("cols") + p["c"]), F.transform("_p", lambda p: p["luma"]))
    filled = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_rows") * F.col("cols") - 1), lambda i: F.element_at(at, i))
    return presence_of_grids(grids.select(image, "cols", F.when(whole, F.col("_p.luma")).otherwise(filled).alias("luma")), image)
