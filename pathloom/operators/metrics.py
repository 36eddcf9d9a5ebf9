"""Thresholds and reports over tables of measured operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats


@dataclass(frozen=True)
class Thresholds:
    """The defaults, in milliseconds, bytes, milliseconds and items a second."""

    max_duration: float = 5000
    max_memory_usage: float = 104_857_600
    max_cpu_usage: float = 1000
    min_throughput: float = 1000


def check_thresholds(metrics: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Adds passed, warnings and errors to (duration, memory_usage, cpu_usage, throughput) rows."""
    duration = lambda c: formats.duration(c)
    per_second = lambda c: formats.throughput(c, "items/s")

    def warn(name: str, kind: str, bad: Column, limit: float, show, middle: str, label: str) -> Column:
        text = F.concat(F.lit(f"{label} "), show(F.col(name)), F.lit(f" {middle} "), show(F.lit(limit)))
        fields = (F.lit(kind).alias("type"), text.alias("message"), F.col(name).cast("double").alias("value"), F.lit(float(limit)).alias("threshold"), F.lit("warning").alias("severity"))
        return F.when(bad, F.struct(*fields))

    #: The messages.
    over = "exceeds threshold"
    warnings = F.array_compact(F.array(
        warn("duration", "duration", F.col("duration") > limits.max_duration, limits.max_duration, duration, over, "Duration"),
        warn("memory_usage", "memory", F.col("memory_usage") > limits.max_memory_usage, limits.max_memory_usage, formats.number_of_bytes, over, "Memory usage"),
        warn("cpu_usage", "cpu", F.col("cpu_usage") > limits.max_cpu_usage, limits.max_cpu_usage, duration, over, "CPU usage"),
        warn("throughput", "throughput", F.col("throughput") < limits.min_throughput, limits.min_throughput, per_second, "below threshold", "Throughput"),
    ))
    severe = F.concat(F.lit("Severe performance degradation: "), duration(F.col("duration")))
    errors = F.array_compact(F.array(F.when(F.col("duration") > 2 * limits.max_duration, severe)))
    checked = metrics.withColumn("warnings", warnings).withColumn("errors", errors)
    return checked.withColumn("passed", (F.size("warnings") == 0) & (F.size("errors") == 0))


def report(metrics: DataFrame) -> DataFrame:
    """One row: operations and mean duration, memory and throughput."""
    return metrics.agg(
        F.count(F.lit(1)).alias("operations"), F.avg("duration").alias("avg_duration"), F.avg("memory_usage").alias("avg_memory_usage"),
        F.avg("throughput").alias("avg_throughput"),
    )


def recent(metrics: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The last ``n`` operations, oldest of them first."""
    return metrics.orderBy(F.desc(order)).limit(n).orderBy(order)


def describe(duration: Column, memory: Column, cpu: Column, throughput: Column, hits: Column, misses: Column) -> Column:
    """The text report of one operation."""
    rate = F.when(hits + misses > 0, F.format_string("%.2f", hits / (hits + misses) * 100)).otherwise("0")
    #: The lines of the report.
    parts = (
        ("Performance Metrics\n==================\n\nDuration: ", formats.duration(duration)), ("\nMemory Usage: ", formats.number_of_bytes(memory)),
        ("\nCPU Usage: ", formats.duration(cpu)), ("\nThroughput: ", formats.throughput(throughput, "items/s")),
        ("\nCache Hits: ", hits.cast("string")), ("\nCache Misses: ", misses.cast("string")), ("\nHit Rate: ", rate),
    )
    return F.concat(*(x for text, c in parts for x in (F.lit(text), c)), F.lit("%"))


def recent_lines(metrics: DataFrame, order: str, n: int = 10) -> DataFrame:
    """(place, line): the last ``n`` operations as report lines."""
    from pyspark.sql import Window

    last = recent(metrics, order, n)
    place = F.row_number().over(Window.orderBy(order))  # of at most n rows
    text = F.concat(
        place.cast("string"), F.lit(". Duration: "), formats.duration("duration"), F.lit(", Memory: "), formats.number_of_bytes("memory_usage"),
        F.lit(", Throughput: "), formats.throughput("throughput", "items/s"),
    )
    return last.select(place.alias("place"), text.alias("line"))
