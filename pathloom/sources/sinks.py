"""Where results go."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("pathloom")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or under a local master a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out and kept as a checkpoint in the shared folder, so that rounds don't repeat each other's work.

    Spark deletes checkpoints that nothing refers to any more, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(shared or scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def write_text(paths: DataFrame, target: str, *, mode: str = "errorifexists", value: str = "value") -> None:
    """Values, one a line, in order of document and emission; mode ``overwrite`` replaces."""
    paths.orderBy("doc_id", "ordinal").select(value).write.mode(mode).text(target)


def write_rows(paths: DataFrame, target: str, kind: str = "json", *, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """Path rows as json, csv or parquet."""
    writer = paths.write.mode(mode).option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(target)


def joined(paths: DataFrame, value: str = "value") -> DataFrame:
    """(doc_id, text): each document's values joined by newlines, for a clipboard."""
    rows = paths.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", value))).alias("_all"))
    return rows.select("doc_id", F.array_join(F.transform("_all", lambda r: r[value]), "\n").alias("text"))


def as_json(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns))


def event(name: str, properties: dict | None = None, *, enabled: bool = False) -> None:
    """A telemetry line in the log, off unless enabled."""
    if enabled:
        log.info("%s %s", name, properties or {})
