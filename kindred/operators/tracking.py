"""Tracking one identity through a video: smoothing, lock and loss, camera output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import hypot

import pandas as pd
from pyspark.sql import DataFrame

from ..cluster import ship

SEARCHING, LOCKED, RECOVERING, LOST = "searching", "locked", "recovering", "lost"
#: Fixed values of the tracker's rules.
PROCESS_NOISE, MEASUREMENT_NOISE, FIRST_VARIANCE = 4.0, 16.0, 100.0
RECOVERING_MISSES, LOST_MISSES, PREDICTED_MISSES, HELD_MISSES = 18, 90, 6, 24
JUMP_IOU, JUMP_GAP, JUMP_VOTES = 0.03, 0.04, 2


def _unit(x: float) -> float:
    return min(max(x, 0.0), 1.0)


@dataclass(frozen=True)
class Rect:
    x1: float
    y1: float
    x2: float
    y2: float

    @property
    def centre(self) -> tuple[float, float]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    @property
    def longer(self) -> float:
        return max(self.x2 - self.x1, self.y2 - self.y1)

    def far(self, point: tuple[float, float]) -> float:
        x, y = self.centre
        return hypot(x - point[0], y - point[1])

    def iou(self, other: Rect | None) -> float:
        if other is None:
            return 0.0
        w, h = min(self.x2, other.x2) - max(self.x1, other.x1), min(self.y2, other.y2) - max(self.y1, other.y1)
        both = max(w, 0.0) * max(h, 0.0)
        areas = [(r.x2 - r.x1) * (r.y2 - r.y1) for r in (self, other)]
        return both / (sum(areas) - both) if both else 0.0

    def closeness(self, point: tuple[float, float], reach: float) -> float:
        return 1.0 - _unit(self.far(point) / max(self.longer * reach, 1.0))


@dataclass(frozen=True)
class Seen:
    """A recognised box."""

    box: Rect
    similarity: float
    margin: float
    body: float | None = None

    @property
    def body_score(self) -> float | None:
        return None if self.body is None else _unit((self.body + 1) / 2)


@dataclass
class Motion:
    """A constant-velocity filter; both axes share one covariance, as noise and start are alike for both."""

    x: float
    y: float
    vx: float = 0.0
    vy: float = 0.0
    pp: float = FIRST_VARIANCE
    pv: float = 0.0
    vv: float = FIRST_VARIANCE

    def predict(self) -> None:
        self.x, self.y = self.x + self.vx, self.y + self.vy
        self.pp, self.pv, self.vv = self.pp + 2 * self.pv + self.vv + PROCESS_NOISE, self.pv + self.vv, self.vv + PROCESS_NOISE

    def correct(self, x: float, y: float) -> None:
        gain, drag = self.pp / (self.pp + MEASUREMENT_NOISE), self.pv / (self.pp + MEASUREMENT_NOISE)
        dx, dy = x - self.x, y - self.y
        self.x, self.y, self.vx, self.vy = self.x + gain * dx, self.y + gain * dy, self.vx + drag * dx, self.vy + drag * dy
        self.pp, self.pv, self.vv = (1 - gain) * self.pp, (1 - gain) * self.pv, self.vv - drag * self.pv


@dataclass
class Tracker:
    """The state of one track. Each frame goes to `recognised`, or to `supported` where recognition is skipped.

    Both return (cx, cy, half_size, source, misses) or None without a camera. A skipped frame without a supporting box counts
    twice in the frame index, and the index survives a reset, as the stride's phase depends on them.
    """

    hint: tuple[float, float] | None = None
    motion: Motion | None = None
    half: float = 0.0
    misses: int = 0
    hits: int = 0
    frame: int = 0
    likeness: float = 0.6
    state: str = SEARCHING
    last: Rect | None = None
    confirmed: Rect | None = None
    jump: tuple[Rect, int] | None = None
    camera: tuple | None = None
    predicted: int = 0
    held: int = 0

    def recognises(self) -> bool:
        stride = {SEARCHING: 2, LOCKED: 3 if self.likeness > 0.82 else 2}.get(self.state, 1)
        return self.frame % stride == 0

    def aim(self) -> tuple[float, float] | None:
        return (self.motion.x, self.motion.y) if self.motion else self.hint

    def view(self, source: str) -> tuple | None:
        return (self.motion.x, self.motion.y, self.half, source, self.misses) if self.motion else None

    def recognised(self, seen: list[Seen], threshold: float, margin: float) -> tuple | None:
        self.frame += 1
        best = self._choose([s for s in seen if s.similarity >= threshold and s.margin >= margin], threshold, margin)
        if best is None:
            return self._missed()
        self.misses, self.hits, self.predicted, self.held, self.jump = 0, self.hits + 1, 0, 0, None
        self.likeness = 0.85 * self.likeness + 0.15 * _unit(best.similarity)
        self._follow(best.box, 0.12)
        self.hint, self.last, self.confirmed = None, best.box, best.box
        self.state = LOCKED if self.hits >= 2 else RECOVERING
        self.camera = self.view("observed")
        return self.camera

    def supported(self, persons: list[Rect]) -> tuple | None:
        self.frame += 1
        box = self._support(persons)
        if box is None:
            self.frame += 1
            if self.motion:
                self.motion.predict()
            return self.view("predicted")
        self._follow(box, 0.06)
        self.last, self.predicted, self.held = box, 0, 0
        return self.view("predicted")

    def _follow(self, box: Rect, weight: float) -> None:
        half = box.longer / 2
        if self.motion is None:
            self.motion, self.half = Motion(*box.centre), half
        else:
            self.motion.predict()
            self.motion.correct(*box.centre)
        self.half = half if self.half <= 1.2e-7 else (1 - weight) * self.half + weight * half

    def _choose(self, viable: list[Seen], threshold: float, margin: float) -> Seen | None:
        aim = self.aim()
        if not viable or aim is None:
            return viable[0] if viable else None
        score = lambda s: s.similarity + 0.20 * s.margin + 0.16 * s.box.closeness(aim, 8) + 0.16 * _unit(s.box.iou(self.last)) + 0.12 * (s.body_score or 0.0)
        ranked = sorted(viable, key=lambda s: (-score(s), s.box.far(aim)))
        best = ranked[0]
        if self.state in (LOCKED, RECOVERING) and self.last is not None and best.box.iou(self.last) < JUMP_IOU:
            clear = len(ranked) > 1 and score(best) - score(ranked[1]) >= JUMP_GAP
            sure = best.similarity >= threshold + 0.06 and best.margin >= margin + 0.02 and (best.body_score is None or best.body_score >= 0.58)
            if not (clear and sure) and not self._votes(best.box):
                return None
        self.jump = None
        return best

    def _votes(self, box: Rect) -> bool:
        """Whether enough successive frames saw the target jump to about this place."""
        if self.jump is not None:
            old, votes = self.jump
            near = old.iou(box) >= 0.20 or old.far(box.centre) <= 1.6 * max(old.longer, box.longer)
            self.jump = (old, votes + 1) if near else (box, 1)
            return self.jump[1] >= JUMP_VOTES
        self.jump = (box, 1)
        return False

    def _support(self, persons: list[Rect]) -> Rect | None:
        aim = self.aim()
        if not persons or aim is None:
            return None
        closeness, overlap = (lambda b: b.closeness(aim, 6)), (lambda b: _unit(b.iou(self.last)))
        best = min(persons, key=lambda b: (-(0.35 * closeness(b) + 0.65 * overlap(b)), -closeness(b)))
        if self.state in (LOCKED, RECOVERING) and self.last is not None:
            far = best.far(self.last.centre) > 2.2 * max(self.last.longer, best.longer)
            if far and overlap(best) < 0.08 and closeness(best) < 0.50:
                return None
        return best

    def _missed(self) -> tuple | None:
        self.misses, self.hits = self.misses + 1, 0
        if self.state == SEARCHING and self.motion is None:
            return None
        if self.state == LOCKED:
            self.state = RECOVERING
        elif self.state == RECOVERING and self.misses > RECOVERING_MISSES:
            self.state = LOST
        elif self.state == LOST and self.misses > LOST_MISSES:
            self.__init__(None, frame=self.frame)
            return None
        if self.predicted < PREDICTED_MISSES:
            self.predicted += 1
            if self.motion:
                self.motion.predict()
            return self.view("predicted")
        if self.camera is not None and self.held < HELD_MISSES:
            self.held += 1
            return (*self.camera[:3], "held", self.misses)
        return None


OUTPUT = "track_id string, frame_index long, recognised boolean, state string, cx double, cy double, half_size double, source string, miss_count long"


def advance(tracker: Tracker, row, threshold: float, margin: float) -> dict:
    """Give a frame (seen, persons: lists of structs) to the tracker; the output row without its track id."""
    looks = tracker.recognises()
    if looks:
        seen = [Seen(Rect(o["x1"], o["y1"], o["x2"], o["y2"]), o["similarity"], o["margin"], o["body_similarity"]) for o in row.seen]
        out = tracker.recognised(seen, threshold, margin)
    else:
        out = tracker.supported([Rect(p["x1"], p["y1"], p["x2"], p["y2"]) for p in row.persons])
    cx, cy, half, source, misses = out or (None,) * 5
    return {"frame_index": row.frame_index, "recognised": looks, "state": tracker.state, "cx": cx, "cy": cy, "half_size": half, "source": source, "miss_count": misses}


def frame(rows: list[dict], track) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.strip().split()[0] for c in OUTPUT.split(",")])
    out["track_id"] = track
    out["miss_count"] = out["miss_count"].astype("Int64")
    return out


def track(rows: DataFrame, threshold: float = 0.6, margin: float = 0.03) -> DataFrame:
    """The camera at each frame of each track. `rows` has track_id, frame_index, seen and persons (arrays of structs).

    Tracks are dealt to tasks and streamed in frame order; only a track's state is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tracker = None, None
        for batch in batches:
            for key, part in batch.groupby("track_id", sort=False):
                if key != now:
                    now, tracker = key, Tracker()
                yield frame([advance(tracker, r, threshold, margin) for r in part.itertuples(index=False)], key)

    ship(rows.sparkSession)
    dealt = rows.select("track_id", "frame_index", "seen", "persons").repartition("track_id").sortWithinPartitions("track_id", "frame_index")
    return dealt.mapInPandas(run, OUTPUT)
