"""Measured, limited and cancellable runs of extractions.

What an extraction made is observed while it is written, by Spark's accumulating metrics of
the one job, and not counted again. A limit of time, or a caller who gives up, cancels
the run's own jobs by their tag; other jobs of the session run on, and what was written goes.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .metrics import Thresholds, check_thresholds

T = TypeVar("T")


class Cancelled(RuntimeError):
    """The run was given up by its caller."""


@dataclass
class Token:
    """Gives up a run from any thread."""

    _event: threading.Event = field(default_factory=threading.Event)

    def cancel(self) -> None:
        self._event.set()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()

    def wait(self, seconds: float | None) -> bool:
        return self._event.wait(seconds)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any store that Spark reaches."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def within(spark: SparkSession, run: Callable[[], T], *, seconds: float | None = None, token: Token | None = None, writes: str | None = None) -> T:
    """What ``run`` returns, if it ends within ``seconds`` and nobody cancels ``token``; else TimeoutError or Cancelled.

    The jobs that ``run`` starts in this thread carry a tag of their own, by which a watching thread cancels
    them. ``writes``: the new folder that ``run`` writes, deleted if the run does not end, whatever
    the reason. A run that has ended by itself stands, even if the limit passes meanwhile.
    """
    if token and token.cancelled:
        raise Cancelled("cancelled before it began")
    context, tag, token = spark.sparkContext, f"pathloom-{uuid.uuid4().hex}", token or Token()
    over, why = threading.Event(), []

    def watch() -> None:
        end = None if seconds is None else time.monotonic() + seconds
        while not over.is_set():
            left = 0.1 if end is None else min(0.1, end - time.monotonic())
            if token.wait(max(0.0, left)):
                why.append(Cancelled("cancelled"))
            elif end is not None and time.monotonic() >= end:
                why.append(TimeoutError(f"not done within {seconds:g} s"))
            if why:
                while not over.wait(0.2):  # jobs that begin later are cancelled too
                    context.cancelJobsWithTag(tag)
                return

    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        result = run()
    except BaseException as failed:
        over.set()
        if writes:
            remove(spark, writes)
        if why:
            raise why[0] from failed
        raise
    finally:
        over.set()
        context.removeJobTag(tag)
        watcher.join()
    return result


@dataclass(frozen=True)
class Run:
    """What one extraction did: documents, paths and failures, milliseconds, and UTF-8 bytes of text."""

    documents: int
    paths: int
    failed: int
    bytes: int
    duration: float

    @property
    def throughput(self) -> float:
        """Paths a second."""
        return self.paths / max(self.duration / 1000, 1e-9)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row of (duration, memory_usage, cpu_usage, throughput, documents, paths, failed), as ``check_thresholds`` takes it."""
        row = (float(self.duration), None, None, float(self.throughput), self.documents, self.paths, self.failed)
        return spark.createDataFrame([row], "duration double, memory_usage double, cpu_usage double, throughput double, documents long, paths long, failed long")

    def checked(self, spark: SparkSession, limits: Thresholds = Thresholds()) -> DataFrame:
        """``table`` with passed, warnings and errors; no pass over the data."""
        return check_thresholds(self.table(spark), limits)


def measured(documents: DataFrame, write: Callable[[DataFrame], None], *, size: str | None = None) -> Run:
    """Run ``write`` on an extraction's ``documents`` (see ``engine.Extraction``) and return what went through it.

    Counts are observed in the job that writes. ``size``: a column of ``documents``, kept from
    their texts' bytes, whose sum is reported; without it bytes are 0. An empty input counts 0.
    """
    seen = Observation()
    sizes = F.coalesce(F.sum(F.col(size)), F.lit(0)) if size else F.lit(0)
    watched = documents.observe(
        seen, F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.size("paths").cast("long")), F.lit(0)).alias("paths"),
        F.count_if(~F.col("success")).alias("failed"), F.max(sizes).alias("bytes") if not size else sizes.alias("bytes"),
    )
    began = time.monotonic()
    write(watched)
    took = (time.monotonic() - began) * 1000
    got = seen.get
    return Run(int(got["documents"]), int(got["paths"]), int(got["failed"]), int(got["bytes"] or 0), took)
