"""Trackers as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..cluster import ship
from ..operators.tracking import OUTPUT, Tracker, advance, frame


def track_stream(rows: DataFrame, threshold: float = 0.6, margin: float = 0.03) -> DataFrame:
    """The camera at each frame of each track as frames arrive; a batch's frames are sorted, and batches must come in order."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker()
        part = pd.concat(list(parts)).sort_values("frame_index", kind="stable")
        out = [advance(tracker, r, threshold, margin) for r in part.itertuples(index=False)]
        state.update((pickle.dumps(tracker),))
        yield frame(out, key[0])

    ship(rows.sparkSession)
    grouped = rows.select("track_id", "frame_index", "seen", "persons").groupBy("track_id")
    return grouped.applyInPandasWithState(run, OUTPUT, "tracker binary", "append", GroupStateTimeout.NoTimeout)
