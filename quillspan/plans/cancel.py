"""Stopping work that is under way."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Work:
    """Jobs that can be cancelled together."""

    def __init__(self, spark: SparkSession) -> None:
        self._context, self.group, self.cancelled = spark.sparkContext, f"quillspan-{uuid.uuid4().hex}", False

    def cancel(self) -> None:
        """Ends the running jobs, from whatever thread; those that were to follow don't start."""
        self.cancelled = True
        self._context._jsc.sc().cancelJobGroupAndFutureJobs(self.group)


@contextmanager
def cancellable(spark: SparkSession, what: str = "") -> Iterator[Work]:
    """Jobs of this thread belong to the work that is given.

    A catalog's versions become current only when they are complete, so work
    that is cancelled leaves it as it was.
    """
    work, context = Work(spark), spark.sparkContext
    before = [context.getLocalProperty(x) for x in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")]
    context.setJobGroup(work.group, what, interruptOnCancel=True)
    try:
        yield work
    finally:
        for name, value in zip(("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"), before):
            context.setLocalProperty(name, value)
