"""Jobs that a flag stops while they run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import SparkSession

T = TypeVar("T")


class Cancelled(RuntimeError):
    """The flag was set before the job ended."""


def cancellable(spark: SparkSession, job: Callable[[], T], cancelled: Callable[[], bool], poll_s: float = 0.1) -> T:
    """The job's result, or Cancelled once `cancelled()` holds: its Spark jobs, and those that it still starts, are then stopped.

    The job runs in a thread of its own under a tag; stopped tasks are interrupted. What it had written is left to no one if it
    writes through a store, as no version names it.
    """
    sc, tag, done = spark.sparkContext, f"cancellable-{uuid.uuid4().hex}", {}

    def run() -> None:
        sc.addJobTag(tag)
        sc.setInterruptOnCancel(True)
        try:
            done["value"] = job()
        except BaseException as error:
            done["error"] = error
        finally:
            sc.removeJobTag(tag)
            sc.setInterruptOnCancel(False)

    thread, stopped = InheritableThread(target=run, session=spark), False
    thread.start()
    while thread.is_alive():
        if stopped or cancelled():
            stopped = True
            sc.cancelJobsWithTag(tag)
        thread.join(poll_s)
    if "value" in done:  # it ended before it could be stopped
        return done["value"]
    if stopped:
        raise Cancelled("stopped by its flag") from done.get("error")
    raise done["error"]


def flag_file(spark: SparkSession, path: str) -> Callable[[], bool]:
    """A flag that is set once the file exists, on any file system of Spark; it looks at most twice a second."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen = {"at": 0.0, "set": False}

    def found() -> bool:
        if not seen["set"] and time.monotonic() - seen["at"] >= 0.5:
            seen.update(at=time.monotonic(), set=bool(fs.exists(file)))
        return seen["set"]

    return found
