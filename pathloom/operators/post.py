"""Deduplication and sorting of the lines or values of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, lines, trim, utf16_length


def trimmed_lines(docs: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, ordinal, value): the non-blank lines of each document, trimmed."""
    rows = docs.select(*keep, F.posexplode(lines(content)).alias("ordinal", "value"))
    return rows.withColumn("value", trim("value")).filter(F.col("value") != "")


def dedupe_first(values: DataFrame, by: tuple[str, ...] = ("doc_id",), value: str = "value", order: str = "ordinal") -> DataFrame:
    """The first occurrence of each value in each document, exact and case-sensitive.

    The smallest ordinal is found by a combining aggregate and the other columns
    come with it, so no window holds all rows of a document or value.
    """
    others = [c for c in values.columns if c not in (*by, value)]
    first = F.min(F.struct(order, *(c for c in others if c != order))).alias("_first")
    kept = values.groupBy(*by, value).agg(first)
    return kept.select(*by, value, *(F.col(f"_first.{c}").alias(c) for c in others)).select(*values.columns)


def numbered(paths: str) -> Column:
    """The paths of an array as (ordinal, path)."""
    return F.transform(paths, lambda p, i: F.struct(i.alias("ordinal"), p.alias("path")))


def first_in_array(paths: str) -> Column:
    """(ordinal, path) of the first of equal values of a document's array of paths, in order; nothing leaves the row.

    Equal values lie next to each other once the array is sorted, so this costs a sort and not a comparison of all pairs.
    """
    keyed = F.array_sort(F.transform(paths, lambda p, i: F.struct(p["value"].alias("value"), i.alias("ordinal"), p.alias("path"))))
    firsts = let(keyed, lambda rows: F.filter(rows, lambda x, i: (i == 0) | (F.get(rows, i - 1)["value"] != x["value"])))
    return F.array_sort(F.transform(firsts, lambda x: F.struct(x["ordinal"].alias("ordinal"), x["path"].alias("path"))))


def ranked_in_array(paths: str, mode: str) -> Column:
    """(rank, ordinal, path) of a document's array of paths in one of the four orders; nothing leaves the row.

    Descending orders are ascending ones reversed, with ordinals negated, so that equal keys stay in order.
    """
    down = mode.endswith("-desc")
    key = lambda p: F.collate(p["value"], "UNICODE") if mode.startswith("alpha") else utf16_length(p["value"])
    place = lambda i: -i if down else i
    rows = F.array_sort(F.transform(paths, lambda p, i: F.struct(key(p).alias("key"), place(i).alias("place"), i.alias("ordinal"), p.alias("path"))))
    rows = F.reverse(rows) if down else rows
    return F.transform(rows, lambda x, i: F.struct((i + 1).alias("rank"), x["ordinal"].alias("ordinal"), x["path"].alias("path")))


def removed_counts(docs: DataFrame, content: str = "content") -> DataFrame:
    """(doc_id, total, kept, removed): lines before and after deduplication; blank lines count as removed."""
    every = F.transform(lines(content), lambda x: trim(x))
    kept = F.size(F.array_distinct(F.filter(every, lambda x: x != "")))
    total = F.size(every)
    return docs.select("doc_id", total.alias("total"), kept.alias("kept"), (total - kept).alias("removed"))


def sort_keys(mode: str, value: str = "value", order: str = "ordinal") -> list[Column]:
    """Keys of the four orders; equal keys stay in order of ``ordinal`` in all of them."""
    keys = {
        "alpha-asc": F.collate(value, "UNICODE").asc(), "alpha-desc": F.collate(value, "UNICODE").desc(),
        "length-asc": utf16_length(value).asc(), "length-desc": utf16_length(value).desc(),
    }
    return [keys[mode], F.col(order).asc()]


def ranked(values: DataFrame, mode: str, by: tuple[str, ...] = ("doc_id",), value: str = "value", order: str = "ordinal") -> DataFrame:
    """Adds rank: each value's 1-based place in its document."""
    return values.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*sort_keys(mode, value, order))))


def sort_values(values: DataFrame, mode: str, by: tuple[str, ...] = ("doc_id",), value: str = "value", order: str = "ordinal") -> DataFrame:
    """All rows, ordered by document and then by the mode's keys."""
    return values.orderBy(*by, *sort_keys(mode, value, order))
