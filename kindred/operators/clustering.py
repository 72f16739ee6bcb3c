"""Online clustering of observations into identities, merging, and candidates.

Both steps depend on order, so a scan's observations are streamed in frame order through one task and only its clusters are
held; scans run side by side.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship

#: Fixed values of the merge rule.
STRONG, SOFT, SOFT_FAR, SOFT_SEEN = 0.84, 0.80, 0.11, 5
STRONG_FACE = 0.58
#: Fixed values of the duplicate score: anchors further apart never are, and the difference of confidences that counts for nothing.
DUPLICATE_FAR, DUPLICATE_GAP = 0.28, 0.30


@dataclass(frozen=True)
class Config:
    """Settings of a scan; the defaults are the balanced mode."""

    sample_stride: int = 12
    max_sampled_frames: int = 900
    max_faces_per_frame: int = 6
    cluster_similarity: float = 0.77
    duplicate_similarity: float = 0.87
    min_observations: int = 2
    min_embedding_similarity: float = 0.69
    min_face_crop_edge: int = 46
    max_candidates: int = 18
    max_duplicates: int = 36
    min_thumbnail_quality: float = 0.54
    min_face_presence: float = 0.44
    anchor_scale: float = 1.0  # 1 compares anchors in the units they come in
    least_duplicate_cosine: float = 0.70

    @classmethod
    def of_mode(cls, mode: str) -> Config:
        if mode == "fast":
            return cls(18, 520, 4, 0.79, 0.88, 3, 0.72, 52, 12, 24, 0.60, 0.52)
        if mode == "quality":
            return cls(8, 1400, 8, 0.75, 0.85, 2, 0.66, 38, 28, 60, 0.48, 0.36)
        return cls()

    def looser(self) -> Config:
        """The second pass after too few candidates."""
        return replace(
            self, sample_stride=max(self.sample_stride // 2, 4), max_sampled_frames=self.max_sampled_frames * 2,
            max_faces_per_frame=min(self.max_faces_per_frame + 2, 10), cluster_similarity=max(self.cluster_similarity - 0.02, 0.70),
            duplicate_similarity=max(self.duplicate_similarity - 0.01, 0.82), min_observations=max(self.min_observations, 2),
            min_embedding_similarity=max(self.min_embedding_similarity - 0.02, 0.64), min_face_crop_edge=max(self.min_face_crop_edge - 6, 34),
            max_candidates=min(self.max_candidates + 10, 42), max_duplicates=min(self.max_duplicates + 24, 96),
            min_thumbnail_quality=max(self.min_thumbnail_quality - 0.04, 0.40), min_face_presence=max(self.min_face_presence - 0.04, 0.28),
        )


def presets(spark) -> DataFrame:
    """A row a mode: its settings, and those of its second pass with the prefix loose_."""
    names = ("sample_stride", "max_sampled_frames", "cluster_similarity", "max_candidates")
    rows = []
    for mode in ("fast", "balanced", "quality"):
        config = Config.of_mode(mode)
        rows.append((mode, *[getattr(c, n) for c in (config, config.looser()) for n in names]))
    kinds = ("int", "int", "double", "int")
    return spark.createDataFrame(rows, "mode string, " + ", ".join(f"{p}{n} {k}" for p in ("", "loose_") for n, k in zip(names, kinds)))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.sqrt((v * v).sum())), 1e-10)


class Clusters:
    """The clusters of one scan: a matrix of centroids and a table of sums, one row each."""

    SUMS = ("confidence", "similarity", "presence", "x", "y")

    def __init__(self, gate: float) -> None:
        self.gate = gate
        self.room = np.empty((0, 0))  # of which the first rows are used; it doubles when full
        self.sums_room = np.empty((0, len(self.SUMS)))
        self.seen: list[int] = []
        self.strong: list[int] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.quality: list[float] = []

    @property
    def centroids(self) -> np.ndarray:
        return self.room[: len(self.seen)]

    @property
    def sums(self) -> np.ndarray:
        return self.sums_room[: len(self.seen)]

    def add(self, frame: int, x: float, y: float, confidence: float, vector: np.ndarray, presence: float, size: float) -> tuple[int, float]:
        """Put an observation in the cluster of largest cosine, the first of equal ones, or in a new one below the gate."""
        sims = self.centroids @ vector if len(self.seen) else np.empty(0)
        at = int(sims.argmax()) if len(sims) else -1
        sim = float(sims[at]) if at >= 0 else -1.0
        joins = at >= 0 and sim > -1.0 and sim >= self.gate
        like = sim if joins else 1.0
        bound = lambda v: min(max(v, 0.0), 1.0)
        quality = bound(0.40 * bound(size) + 0.20 * bound(confidence) + 0.16 * bound(like) + 0.24 * bound(presence))
        row = np.array([confidence * max(sim, 0.1) if joins else confidence, bound(like), presence, x, y])
        if joins:
            n = self.seen[at]
            self.centroids[at] = _unit((self.centroids[at] * n + vector) / (n + 1))
            self.sums[at] += row
            self.seen[at] += 1
            self.last[at] = frame
            self.strong[at] += presence >= STRONG_FACE
            self.quality[at] = max(self.quality[at], quality)
            return at, sim
        n = len(self.seen)
        if n == len(self.room):
            room, sums = np.empty((max(8, 2 * n), len(vector))), np.empty((max(8, 2 * n), len(self.SUMS)))
            if n:
                room[:n], sums[:n] = self.room, self.sums_room
            self.room, self.sums_room = room, sums
        self.room[n], self.sums_room[n] = vector, row
        for column, value in ((self.seen, 1), (self.strong, int(presence >= STRONG_FACE)), (self.first, frame), (self.last, frame), (self.quality, quality)):
            column.append(value)
        return len(self.seen) - 1, 1.0

    def merge(self, scale: float = 1.0) -> int:
        """Merge the most similar mergeable pair, the first of equal ones, until none is left; the number of merges.

        The right one's place is taken by the last cluster, as ids count places after merging. Only pairs that may merge are held, in
        lists by cluster and in a heap by similarity; a merge changes those of the two clusters and renames those of the last. An
        entry of the heap counts if the lists still have it. So memory grows with the mergeable pairs, and a merge costs one
        product of the new centroid with all others.
        """
        end, merges = len(self.seen), 0
        n = np.array(self.seen, float)
        near: list[dict[int, float]] = [{} for _ in range(end)]
        heap: list[tuple[float, int, int]] = []

        def fitting(at: slice, cosine: np.ndarray) -> np.ndarray:
            """Which of the clusters may merge with those of `at`, by their cosines (a row for each of `at`)."""
            anchors = self.sums[:end, 3:5] / n[:end, None] / scale
            far = np.sqrt(((anchors[None] - anchors[at][:, None]) ** 2).sum(axis=2))
            return (cosine >= STRONG) | ((cosine >= SOFT) & (far <= SOFT_FAR) & (n[None, :end] + n[at][:, None] >= SOFT_SEEN))

        def note(i: int, j: int, cosine: float) -> None:
            near[i][j] = near[j][i] = cosine
            heap.append((-cosine, min(i, j), max(i, j)))

        for low in range(0, end, 256):
            at = slice(low, min(low + 256, end))
            cosine = self.centroids[at] @ self.centroids[:end].T
            for i, j in zip(*(x.tolist() for x in np.nonzero(fitting(at, cosine)))):
                if low + i < j:
                    note(low + i, j, float(cosine[i, j]))
        heapq.heapify(heap)
        while heap:
            cosine, left, right = heapq.heappop(heap)
            if right >= end or near[left].get(right) != -cosine:
                continue
            self.room[left] = _unit((self.room[left] * n[left] + self.room[right] * n[right]) / (n[left] + n[right]))
            self.sums_room[left] += self.sums_room[right]
            n[left] += n[right]
            self.seen[left] += self.seen[right]
            self.strong[left] += self.strong[right]
            self.first[left] = min(self.first[left], self.first[right])
            self.last[left] = max(self.last[left], self.last[right])
            self.quality[left] = max(self.quality[left], self.quality[right])
            for i in (left, right):
                for j in near[i]:
                    del near[j][i]
                near[i] = {}
            end -= 1
            self.room[right], self.sums_room[right], n[right] = self.room[end], self.sums_room[end], n[end]
            for column in (self.seen, self.strong, self.first, self.last, self.quality):
                column[right] = column[end]
                column.pop()
            moved = near.pop()
            if right < end:
                for j, value in moved.items():
                    del near[j][end]
                    near[right][j] = near[j][right] = value
                    heapq.heappush(heap, (-value, min(j, right), max(j, right)))
            row = self.centroids @ self.room[left]
            fits = fitting(slice(left, left + 1), row[None])[0]
            fits[left] = False
            for j in np.flatnonzero(fits).tolist():
                near[left][j] = near[j][left] = float(row[j])
                heapq.heappush(heap, (-float(row[j]), min(j, left), max(j, left)))
            merges += 1
        return merges

    def candidates(self, config: Config) -> list[dict]:
        """Clusters that pass every gate, best first, truncated."""
        out = []
        for i, n in enumerate(self.seen):
            score, similarity, presence, x, y = (self.sums[i] / n).tolist()
            gates = (
                n >= config.min_observations, similarity >= config.min_embedding_similarity, self.quality[i] >= config.min_thumbnail_quality,
                presence >= config.min_face_presence, self.strong[i] >= max(config.min_observations // 2, 1),
            )
            if all(gates):
                confidence = 0.36 + min(n * 0.08, 0.44) + score * 0.16 + similarity * 0.16 + presence * 0.10 + self.quality[i] * 0.12
                out.append({
                    "id": i, "confidence": min(max(confidence, 0.0), 0.995), "observations": n, "first_frame": self.first[i], "last_frame": self.last[i],
                    "anchor_x": x, "anchor_y": y, "embedding": self.centroids[i].tolist(),
                })
        out.sort(key=lambda c: (-c["confidence"], -c["observations"], c["id"]))
        return out[: config.max_candidates]


def _streamed(rows: DataFrame, visit, schema: str) -> DataFrame:
    """Deal scans to tasks, sort by scan and frame, and let `visit` see each scan's batches in order and its end (None)."""
    ship(rows.sparkSession)
    columns = ["scan_id", "frame_index", "anchor_x", "anchor_y", "confidence", "embedding", "face_presence", "quality"]
    dealt = rows.select(*columns).repartition("scan_id").sortWithinPartitions("scan_id", "frame_index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan, state = None, None
        for batch in batches:
            for key, part in batch.groupby("scan_id", sort=False):
                if key != scan:
                    if scan is not None and (end := visit(scan, state, None)) is not None:
                        yield end
                    scan, state = key, {}
                if (out := visit(key, state, part)) is not None:
                    yield out
        if scan is not None and (end := visit(scan, state, None)) is not None:
            yield end

    return dealt.mapInPandas(run, schema)


def _add_all(clusters: Clusters, part: pd.DataFrame) -> list[tuple[int, float]]:
    return [
        clusters.add(int(r.frame_index), r.anchor_x, r.anchor_y, r.confidence, np.asarray(r.embedding, float), r.face_presence, r.quality)
        for r in part.itertuples(index=False)
    ]


def leader_labels(rows: DataFrame, gate: float) -> DataFrame:
    """The cluster that each observation went to, and its cosine then (1 for the first of a cluster)."""

    def visit(scan, state, part):
        if part is None:
            return None
        got = _add_all(state.setdefault("clusters", Clusters(gate)), part)
        return pd.DataFrame({"scan_id": scan, "frame_index": part["frame_index"].to_numpy(), "cluster": [c for c, _ in got], "similarity": [s for _, s in got]})

    return _streamed(rows, visit, "scan_id string, frame_index long, cluster long, similarity double")


REPORT = (
    "scan_id string, id long, confidence double, observations long, first_frame long, last_frame long, anchor_x double, anchor_y double,"
    " embedding array<double>, duplicates array<struct<a:long,b:long,similarity:double>>, merged_clusters long, suppressed_clusters long,"
    " all_observations long, rescanned boolean"
)


def duplicate_pairs(found: list[dict], config: Config) -> list[dict]:
    """Pairs of a report's candidates whose duplicate score reaches the threshold, best first, truncated."""
    bound = lambda v: min(max(v, 0.0), 1.0)
    pairs = []
    for i, a in enumerate(found):
        for b in found[i + 1 :]:
            cosine = bound(float(np.dot(a["embedding"], b["embedding"])))
            far = float(np.hypot(a["anchor_x"] - b["anchor_x"], a["anchor_y"] - b["anchor_y"]))
            if cosine < config.least_duplicate_cosine or far > DUPLICATE_FAR:
                continue
            shared = min(a["last_frame"], b["last_frame"]) - max(a["first_frame"], b["first_frame"]) + 1
            shorter = 1 + min(max(x["last_frame"] - x["first_frame"], 0) for x in (a, b))
            near = bound(1.0 - abs(a["confidence"] - b["confidence"]) / DUPLICATE_GAP)
            score = bound(cosine * 0.78 + (1.0 - bound(far)) * 0.10 + (bound(shared / shorter) if shared > 0 else 0.0) * 0.08 + near * 0.04)
            if score >= config.duplicate_similarity:
                pairs.append({"a": a["id"], "b": b["id"], "similarity": score})
    pairs.sort(key=lambda p: (-p["similarity"], p["a"], p["b"]))
    return pairs[: config.max_duplicates]


def tightened(found: list[dict], expected: int | None) -> list[dict]:
    """With more candidates than expected, the most observed ones, two more than expected."""
    if not expected or len(found) <= expected:
        return found
    return sorted(found, key=lambda c: (-c["observations"], -c["confidence"], c["id"]))[: expected + 2]


def _finish(clusters: Clusters, config: Config) -> tuple[list[dict], list[dict], dict]:
    """Candidates, duplicates among them, and counters of a scan whose observations are all in."""
    merged = clusters.merge(config.anchor_scale)
    every = len(clusters.seen)
    passed = clusters.candidates(replace(config, max_candidates=every))
    found = passed[: config.max_candidates]
    counters = {"merged_clusters": merged, "suppressed_clusters": every - len(passed), "all_observations": sum(clusters.seen)}
    return found, duplicate_pairs(found, config), counters


def _report(scan, found: list[dict], duplicates: list[dict], counters: dict, again: bool) -> pd.DataFrame:
    rows = found or [dict.fromkeys(("id", "confidence", "observations", "first_frame", "last_frame", "anchor_x", "anchor_y", "embedding"))]
    out = pd.DataFrame([{"scan_id": scan, **counters, **c, "duplicates": duplicates, "rescanned": again} for c in rows])
    for c in ("id", "observations", "first_frame", "last_frame"):
        out[c] = out[c].astype("Int64")
    return out[[c.strip().split()[0] for c in REPORT.split(", ")]]


def discover(rows: DataFrame, config: Config) -> DataFrame:
    """Candidates of each scan, each with the scan's duplicates and counters; a scan without candidates has one row with a null id."""

    def visit(scan, state, part):
        clusters = state.setdefault("clusters", Clusters(config.cluster_similarity))
        if part is not None:
            _add_all(clusters, part)
            return None
        return _report(scan, *_finish(clusters, config), False)

    return _streamed(rows, visit, REPORT)


def needs_second_pass(candidates: int, duplicates: int, any_low: bool, expected: int | None, mode: str) -> bool:
    """Whether a scan is run again with looser settings."""
    return bool((expected is not None and candidates + 1 < expected) or (duplicates and mode != "fast") or any_low)


def discover_adaptively(rows: DataFrame, mode: str, expected: int | None) -> DataFrame:
    """Each scan's report, or that of a second pass with looser settings where the first one's asks for it.

    Scans decide for themselves, so both passes' clusters are kept while a scan's observations stream by once; the second is
    finished only where it is wanted. A report with more candidates than expected is tightened.
    """
    config = Config.of_mode(mode)
    looser = config.looser()

    def visit(scan, state, part):
        first = state.setdefault("first", Clusters(config.cluster_similarity))
        second = state.setdefault("second", Clusters(looser.cluster_similarity))
        if part is not None:
            _add_all(first, part)
            _add_all(second, part)
            return None
        found, duplicates, counters = _finish(first, config)
        low = any(c["confidence"] < 0.6 for c in found)
        found = tightened(found, expected)
        again = needs_second_pass(len(found), len(duplicates), low, expected, mode)
        if again:
            found, duplicates, counters = _finish(second, looser)
            found = tightened(found, expected)
        return _report(scan, found, duplicates, counters, again)

    return _streamed(rows, visit, REPORT)
