"""Validation of path lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.predicates import INVALID, RESERVED_PATTERN, is_valid_path, segments
from ..functions.text import column, trim, utf16_length
from .resolve import small_to_all


def format_errors(c: Column | str) -> Column:
    """What is wrong with a path's form, in order of testing; a blank path has one error."""
    #: The messages, in order.
    c = column(c)
    reserved = F.filter(segments(c), lambda s: s.rlike(RESERVED_PATTERN))
    checks = F.array(
        F.when(c.rlike(f"[{INVALID}]"), "Path contains invalid characters"),
        F.when(F.size(reserved) > 0, F.concat(F.lit("Path contains reserved names: "), F.array_join(reserved, ", "))),
        F.when(c.contains(".."), "Path contains traversal sequences (..)"),
        F.when(utf16_length(c) > 260, "Path exceeds maximum length (260 characters)"),
    )
    return F.when(c.isNull() | (F.length(trim(c)) == 0), F.array(F.lit("Path is empty"))).otherwise(F.array_compact(checks))


def validate_paths(
    paths: DataFrame, entries: DataFrame | None = None, *, value: str = "value", resolved: str | None = None, check_permissions: bool = False
) -> DataFrame:
    """Adds status, exists, permissions, error and resolved_path to path rows.

    ``entries`` (path): an inventory of what exists; without it existence is not
    checked and counts as given. ``resolved``: a column with the resolved path, by
    default the path itself. Addresses and drive paths are invalid for their colon.
    """
    target = F.col(resolved) if resolved else F.col(value)
    wrong = format_errors(value)
    rows = paths.withColumn("_wrong", wrong).withColumn("_target", target)
    if entries is not None:
        known = small_to_all(entries.select(F.col("path").alias("_path")).distinct()).withColumn("_there", F.lit(True))
        rows = rows.join(known, F.col("_target") == F.col("_path"), "left")
        there = F.coalesce("_there", F.lit(False))
    else:
        there = F.lit(True)
    good = F.size("_wrong") == 0
    valid, exempt = good & is_valid_path(value), classify.detect(value) == "url"
    missing = F.concat(F.lit("File not found: "), F.col("_target"))
    ok = valid & (exempt | there)
    error = (
        F.when(~good, F.array_join("_wrong", ", ")).when(~valid, "Path contains invalid characters or reserved names").when(~ok, missing)
    )
    permission = F.when(ok & ~exempt, "read-write") if check_permissions else F.lit(None).cast("string")
    return rows.select(
        *paths.columns, F.when(ok, "valid").otherwise("invalid").alias("status"), F.when(valid, ok).alias("exists"),
        permission.alias("permissions"), error.alias("error"), F.when(valid & ~exempt & (F.col("_target") != F.col(value)), F.col("_target")).alias("resolved_path"),
    )


def rollup(validated: DataFrame) -> DataFrame:
    """One row: valid, invalid, broken and inaccessible counts."""
    return validated.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("valid", "invalid", "broken", "inaccessible")))


def broken_references(paths: DataFrame, entries: DataFrame, resolved: str = "resolved") -> DataFrame:
    """The path rows whose resolved path is not in the inventory."""
    known = small_to_all(entries.select(F.col("path").alias("_path")).distinct())
    return paths.join(known, paths[resolved] == F.col("_path"), "left_anti")
