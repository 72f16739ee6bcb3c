"""Running streams and scheduled batches: polling, maintenance, cancellation, progress."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def drain(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, poll_ms: int = 1200, forever: bool = False) -> StreamingQuery:
    """Hand each batch of arrived messages to `take`; poll at least every 200 ms, or once for all that is there."""
    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{max(poll_ms, 200)} milliseconds") if forever else writer.trigger(availableNow=True)
    return writer.start()


def maintain(job: Callable[[], None], stop: threading.Event, seconds: float = 300.0, least: float = 10.0, runs: int | None = None) -> dict:
    """Run a job every so often until `stop` is set, which also cancels the wait; counts runs and keeps the last error."""
    status = {"runs": 0, "last_error": None}
    while not stop.is_set() and (runs is None or status["runs"] < runs):
        try:
            job()
            status["last_error"] = None
        except Exception as error:  # the loop outlives a failed run and reports it
            status["last_error"] = str(error)
        status["runs"] += 1
        if runs is None or status["runs"] < runs:
            stop.wait(max(seconds, least))
    return status


def listen(spark: SparkSession, tell: Callable[[str, int], None]) -> StreamingQueryListener:
    """Call `tell` with a query's name and rows after each batch."""

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event) -> None: ...

        def onQueryProgress(self, event) -> None:
            tell(event.progress.name, event.progress.numInputRows)

        def onQueryTerminated(self, event) -> None: ...

    listener = Progress()
    spark.streams.addListener(listener)
    return listener
