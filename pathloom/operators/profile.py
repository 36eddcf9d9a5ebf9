"""Profiles of path collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P


def _count(values: DataFrame, name: str, by: tuple[str, ...]) -> DataFrame:
    return values.groupBy(*by, name).agg(F.count(F.lit(1)).alias("count"))


def patterns(
    values: DataFrame, by: tuple[str, ...] = (), value: str = "value", order: tuple[str, ...] = ("doc_id", "ordinal"), examples: int = 3
) -> DataFrame:
    """(*by, pattern, count, percentage, examples): the shapes of normalised paths.

    examples are the first raw values by ``order``. ``values`` are worked out once: path rows meet by
    pattern and by the task that made them, so that a pattern that most paths have is nowhere gathered, and
    each such group leaves a count and its first values.
    """
    rows = values.select(
        *by, F.col(value).alias("_value"), F.struct(*order).alias("_order"), P.pattern(P.normalize(value)).alias("pattern"), F.spark_partition_id().alias("_task")
    )
    key = [*by, "pattern"]
    own, every = Window.partitionBy(*key, "_task"), Window.partitionBy(*key)
    firsts = rows.withColumns({"_place": F.row_number().over(own.orderBy("_order", "_value")), "_n": F.count(F.lit(1)).over(own)}).filter(F.col("_place") <= examples)
    firsts = firsts.withColumn("_rank", F.row_number().over(every.orderBy("_order", "_value")))
    shown = F.collect_list(F.when(F.col("_rank") <= examples, F.struct("_rank", "_value")))
    found = firsts.groupBy(*key).agg(F.sum(F.when(F.col("_place") == 1, F.col("_n"))).alias("count"), F.array_sort(shown).alias("_first"))
    if by:
        found = found.withColumn("_total", F.sum("count").over(Window.partitionBy(*by)))
    else:
        found = found.crossJoin(F.broadcast(found.agg(F.sum("count").alias("_total"))))  # one row, from the same exchange
    values_of = F.transform("_first", lambda x: x["_value"])
    return found.select(*key, "count", (F.col("count") / F.col("_total") * 100).alias("percentage"), values_of.alias("examples"))


def depths(values: DataFrame, by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    return _count(values.withColumn("depth", P.depth(value)), "depth", by)


def namings(values: DataFrame, by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    return _count(values.withColumn("naming", P.naming(P.base_name(value))), "naming", by)


def extensions(values: DataFrame, by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    return _count(values.withColumn("extension", P.extension(value)).filter("extension <> ''"), "extension", by)


def types(values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _count(values, "path_type", by)


def summary(values: DataFrame, by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """(*by, count, unique, duplicates)."""
    distinct = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    out = distinct.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("count"), F.count(F.lit(1)).alias("unique"))
    return out.withColumn("duplicates", F.col("count") - F.col("unique"))
