"""Ending a run in the middle of a job: what asks from another thread, and the tag by which Spark ends the run's jobs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Seconds between two questions.
ASKED_EVERY = 0.5


class Interrupted(Exception):
    """A run that was asked to end."""


@contextmanager
def interruptible(spark: SparkSession, cancelled: Callable[[], bool]) -> Iterator[None]:
    """Jobs of the block carry a tag; once cancelled() says so, Spark ends those that run, and the block ends with Interrupted whatever it makes of that."""
    tag, done, asked = f"ridgeline-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    context = spark.sparkContext

    def watch() -> None:
        while not done.wait(ASKED_EVERY):
            if cancelled():
                asked.set()
                while not done.wait(ASKED_EVERY):  # a job may begin just after others were ended
                    context.cancelJobsWithTag(tag)

    if cancelled():
        raise Interrupted
    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as error:
        if asked.is_set():
            raise Interrupted from error
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
    if asked.is_set():
        raise Interrupted
