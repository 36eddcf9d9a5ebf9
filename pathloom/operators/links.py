"""Real paths by an inventory of symbolic links, in joins: links on folders, links to links, loops.

A path is rewritten at its longest prefix that is a link, until no prefix is one. The
links' own targets are closed first, by pointer jumping: a round replaces a target's
linked prefix by where that link leads so far, so that each round at least doubles the
steps behind a target and a chain needs about as many rounds as the logarithm of its length. Paths then
meet the closed links, once for each link that lies below another's target.

As operating systems do, a path that follows more than ``MOST_FOLLOWED`` links is a loop.
What leads to a loop, or to a link without known target, has no real path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import directory, normalize, posix_resolve
from ..sources.sinks import settled

#: Links that a path follows at most; one that follows more is taken for a loop.
MOST_FOLLOWED = 40


def prefixes(path: Column) -> Column:
    """An absolute path and all its parents but the root."""
    parts = F.split(path, "/", -1)
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(steps, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), lambda p: p != "")


def _step(rows: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """``rows`` (_key, at, follows) after one rewriting by ``links`` (_link, _to, _n), with moved; ``at`` is null behind a dead end or loop.

    A row is one key, so the longest prefix of each is found by a combining aggregate. Links
    that very many rows share meet them in a join whose hot keys Spark splits.
    """
    each = rows.select("_key", F.explode(prefixes(F.col("at"))).alias("_link"))
    longest = each.join(links, "_link").groupBy("_key").agg(F.max(F.struct(F.length("_link").alias("size"), F.col("_to").alias("to"), F.col("_n").alias("n"))).alias("_hit"))
    met = rows.join(longest, "_key", "left")
    rest = F.substring(F.col("at"), F.col("_hit.size") + 1, F.length("at"))
    to, n = F.col("_hit.to"), F.col("follows") + F.col("_hit.n")
    joined = F.when(to.isNotNull() & (n <= most), F.when(to == "/", F.when(rest == "", "/").otherwise(rest)).otherwise(F.concat(to, rest)))
    hit = F.col("_hit").isNotNull()
    return met.select(
        "_key", F.when(hit, joined).otherwise(F.col("at")).alias("at"), F.when(hit, F.least(n, F.lit(most + 1))).otherwise(F.col("follows")).alias("follows"), hit.alias("moved")
    )


def _until_still(rows: DataFrame, links: DataFrame | None, most: int) -> DataFrame:
    """(_key, at, follows) when nothing moves any more; ``links`` None: the rows are the links and jump along themselves.

    Rows whose ``at`` is null stand still from the start: dead ends.
    """
    done, rows = [], settled(rows)
    while True:
        done.append(rows.filter("not moved or at is null").drop("moved"))
        still = reduce(DataFrame.unionByName, done)
        rows = rows.filter("moved and at is not null").drop("moved")
        if not rows.limit(1).count():
            return still
        by = links
        if by is None:  # what stands still is part of what the others jump along
            by = rows.unionByName(still).select(F.col("_key").alias("_link"), F.col("at").alias("_to"), F.col("follows").alias("_n"))
        rows = settled(_step(rows, by, most))


def close_links(links: DataFrame, *, path: str = "path", target: str = "target", most: int = MOST_FOLLOWED) -> DataFrame:
    """(path, real, follows) of every link of an inventory (path, target): where it ends, and after how many links.

    Links are named by absolute paths, with the real names of their folders, as a scan that
    follows no links finds them. A relative target starts at the link's folder. ``real`` is
    null for a link that loops (``follows`` is then ``most`` + 1) or that leads to one without target.
    Paths that are null or not absolute are no links; of links with one path the smallest target
    counts. Every round is an action; rounds grow with the logarithm of the longest chain.
    """
    own = normalize(F.col(path))
    to = F.when(F.col(target).isNotNull() & (F.col(target) != ""), posix_resolve(directory(own), F.replace(F.col(target), F.lit("\\"), F.lit("/"))))
    rows = links.select(own.alias("_key"), to.alias("at")).filter(F.col("_key").startswith("/") & (F.col("_key") != "/"))
    rows = rows.groupBy("_key").agg(F.min("at").alias("at")).withColumn("follows", F.lit(1))
    closed = _until_still(rows.withColumn("moved", F.lit(True)), None, most)
    return closed.select(F.col("_key").alias("path"), F.col("at").alias("real"), "follows")


def real_paths(paths: DataFrame, closed: DataFrame, value: str = "value", *, most: int = MOST_FOLLOWED) -> DataFrame:
    """Adds real and follows: the path without links, and the links on its way; real is null behind a loop or dead end.

    ``closed``: from ``close_links``. Every different path is resolved once. Paths that are not absolute,
    and nulls, have no links. Each round, one for each link below another's target, is an action.
    """
    by = settled(closed.select(F.col("path").alias("_link"), F.col("real").alias("_to"), F.col("follows").alias("_n")))
    distinct = paths.select(F.col(value).alias("_key")).filter(F.col(value).startswith("/")).distinct()
    found = _until_still(distinct.withColumn("at", normalize("_key")).withColumn("follows", F.lit(0)).withColumn("moved", F.lit(True)), by, most)
    rows = paths.join(found.select(F.col("_key").alias("_path"), F.col("at").alias("_at"), F.col("follows").alias("_follows")), F.col(value) == F.col("_path"), "left")
    return rows.select(
        *(f"`{c}`" for c in paths.columns), F.when(F.col("_follows").isNull(), F.col(value)).otherwise(F.col("_at")).alias("real"), F.coalesce("_follows", F.lit(0)).alias("follows")
    )


def canonical_links(paths: DataFrame, links: DataFrame, value: str = "value", **names: str) -> DataFrame:
    """Adds resolved, follows and fallback: the real path, or where there is none the path as it stands, which is a fallback."""
    found = real_paths(paths, close_links(links, **names), value)
    return found.withColumn("fallback", F.col("real").isNull() & F.col(value).isNotNull()).withColumn("resolved", F.coalesce("real", value)).drop("real")
