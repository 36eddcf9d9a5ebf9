"""Mixing sources to target weights, by DataFrame functions alone.

Targets are weighted shares of a budget, capped at ``cap`` times each source and
reshared. Sainte-Laguë apportionment turns them into whole blocks of
``block_tokens`` for every source, and again for the shards of a source: where these
are many, first for groups of shards, so that no window has more than ``FAN_OUT`` of
them. In a shard, documents lie in a seeded order; it gives whole passes and then a run of
blocks that starts at a seeded block, circularly, so every row's share is plain
arithmetic on its place and no block is ever made a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize

#: Up to so many sources their totals are broadcast (a row has a name and a few numbers).
_BROADCAST_SOURCES = 10_000
_SALTS = 32
#: Shards, or groups of them, that blocks are dealt to at once; equal rows that one task lists at once.
FAN_OUT, _LISTED = 512, 4096
PARTS = ("passes", "skipped", "direct", "wrapped")


def words_in(text: str | Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_from(text: Column, first: Column, n: Column) -> Column:
    """``n`` words of a text after the first ``first``, with the white space that follows each."""
    pieces = F.split(F.regexp_replace(text, f"^[{SPACE}]+", ""), f"(?<=[{SPACE}])(?=[^{SPACE}])")
    return F.array_join(F.slice(pieces, (first + 1).cast("int"), n.cast("int")), "")


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds rank, weight and target to (source, source_size) rows.

    Weights repeat over the sources in code point order, null last. The level at
    which weight * level, capped at cap * source_size, adds up to the budget is
    found among the sources in order of the level at which each is full.
    """
    everything = Window.partitionBy()
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    choice = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(choice, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.lit(cap) * F.col("source_size"))
    filled = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(share) * F.sum("source_size").over(everything)
    level = ranked.withColumn("level", (budget - before) / rest).withColumn("place", F.row_number().over(filled))
    first = F.min(
        F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))
    ).over(everything)
    return level.withColumn("target", F.least(F.col("most"), F.coalesce(first["level"] * F.col("weight"), F.col("most")))).select(
        *totals.columns, "rank", "weight", "target"
    )


def sainte_lague(rows: DataFrame, weight: str, seats: Column, order: list[Column], within: list[str], out: str) -> DataFrame:
    """Adds ``out``: seats by the highest quotients weight / (2k + 1) within each group of ``within``.

    Ties go by ``order``. With n rows and h seats, no row ends further than
    quota * n / h + 2 from its quota, so only quotients in that range are ranked:
    about seven for each row, whatever the seats.
    """
    group = Window.partitionBy(*within)
    total, count = F.sum(weight).over(group), F.count(F.lit(1)).over(group)
    q = rows.withColumn("_seats", seats.cast("long"))
    q = q.withColumn("_quota", F.coalesce(F.try_divide(F.col("_seats") * F.col(weight), total), F.lit(0.0)))
    q = q.withColumn("_span", F.coalesce(F.try_divide(F.col("_quota") * count, F.col("_seats")), F.lit(0.0)) + 2)
    q = q.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_quota") - F.col("_span"))).cast("long"))
    q = q.withColumn("_open", F.col("_seats") - F.sum("_sure").over(group))
    q = q.withColumn("_id", F.struct(*order))
    last = F.when(F.col("_quota") > 0, F.ceil(F.col("_quota") + F.col("_span")).cast("long")).otherwise(F.col("_sure"))
    q = q.withColumn("_k", F.explode(F.sequence(F.col("_sure"), last)))
    quotient = F.when(F.col("_quota") > 0, F.col(weight) / (2 * F.col("_k") + 1)).otherwise(F.lit(-1.0))
    rank = F.row_number().over(group.orderBy(quotient.desc(), "_id", "_k"))
    q = q.withColumn("_won", ((rank <= F.col("_open")) & (F.col("_quota") > 0)).cast("long"))
    return q.groupBy(*rows.columns, "_sure").agg((F.first("_sure") + F.sum("_won")).alias(out)).drop("_sure")


def shard_quotas(shards: DataFrame, most: int, fan_out: int | None = None) -> DataFrame:
    """(rank, shard, shard_size, quota): the blocks of each source (rank, shard, blocks, shard_size) dealt to its shards, of which it has at most ``most``.

    Level by level: at each, blocks go to at most ``fan_out`` neighbouring groups of shards.
    """
    fan = fan_out or FAN_OUT
    levels = 1
    while fan**levels < most:
        levels += 1
    if levels > 1:
        shards = materialize(shards, "mixing-shards")
    given = None
    for level in range(levels - 1, -1, -1):
        group = F.floor(F.col("shard") / fan**level).cast("long").alias("group")
        sums = shards.select("rank", group, "blocks", "shard_size").groupBy("rank", "group", "blocks").agg(F.sum("shard_size").alias("shard_size"))
        if given is None:
            quotas = sainte_lague(sums, "shard_size", F.col("blocks"), [F.col("group")], ["rank"], "quota")
        else:
            above = sums.withColumn("above", F.floor(F.col("group") / fan).cast("long")).join(given, ["rank", "above"])
            quotas = sainte_lague(above, "shard_size", F.col("seats"), [F.col("group")], ["rank", "above"], "quota")
        if level:
            given = materialize(quotas.select("rank", F.col("group").alias("above"), F.col("quota").alias("seats")), "mixing-quotas")
    return quotas.select("rank", F.col("group").alias("shard"), "shard_size", "quota")


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    block_tokens: int = 16,
    shard_rows: int = 1024,
    seed: int = 7,
    parts: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    With ``parts`` also what taken is made of: the row's words ``passes`` times,
    ``direct`` words after its first ``skipped``, and its first ``wrapped`` words.

    size: words of the text, 0 for null; a null source is a source of its own,
    last in order. taken: words that the mix takes of the row, repeats counted,
    at most cap * size. Rows may repeat a doc_id; other columns are ignored. The
    same rows and seed give the same mix. An empty table gives no rows.
    """
    alike = docs.select("doc_id", "source", words_in("text").alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_n"))
    alike = materialize(alike, "mixing")
    totals = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.sum("_n").alias("rows"))
    plan = targets(totals, weights, share, cap)
    everything = Window.partitionBy()
    seats = F.floor(F.sum("target").over(everything) / block_tokens + 0.5)
    plan = sainte_lague(plan, "target", seats, [F.col("rank")], [], "blocks")
    plan = materialize(plan.withColumn("shards", F.ceil(F.col("rows") / shard_rows).cast("long")), "mixing-plan")

    # Equal rows are told apart by number, so that they spread over the shards.
    stretch = alike.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(_LISTED).cast("long"))))
    copies = F.sequence(F.col("_from"), F.least(F.col("_n") - 1, F.col("_from") + _LISTED - 1))
    sized = stretch.withColumn("_copy", F.explode(copies)).drop("_n", "_from")
    row_hash = F.xxhash64("doc_id", "size", "_copy", F.lit(seed))
    if plan.count() <= _BROADCAST_SOURCES:
        placed = sized.join(F.broadcast(plan.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
    else:  # too many sources to broadcast: a hot one is spread over salts
        salted = plan.withColumnRenamed("source", "_source").withColumn("_salt", F.explode(F.array(*map(F.lit, range(_SALTS)))))
        placed = sized.withColumn("_own", F.pmod(row_hash, F.lit(_SALTS)).cast("int")).join(
            salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_salt"))
        )
    placed = placed.select(
        "doc_id", "size", "_copy", "rank", "source", "source_size", "target", "blocks", F.pmod(row_hash, F.col("shards")).alias("shard")
    )
    shards = placed.groupBy("rank", "shard", "blocks").agg(F.sum("size").alias("shard_size"))
    quotas = shard_quotas(shards, plan.agg(F.coalesce(F.max("shards"), F.lit(1)).alias("n")).first()["n"])
    quotas = quotas.select(F.col("rank").alias("_rank"), F.col("shard").alias("_shard"), "shard_size", "quota")
    order = Window.partitionBy("rank", "shard").orderBy(F.xxhash64("doc_id", "_copy", F.lit(seed + 1)), "doc_id", "size", "_copy")
    stream = placed.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    row = stream.join(quotas, (F.col("rank") == F.col("_rank")) & (F.col("shard") == F.col("_shard")))

    length = F.col("shard_size")
    want = F.least(F.col("quota") * block_tokens, F.floor(F.lit(cap) * length))
    passes = F.coalesce(F.floor(F.try_divide(want, length)), F.lit(0))
    row = row.withColumn("_passes", passes).withColumn("_rest", want - F.col("_passes") * length)
    blocks = F.greatest(F.lit(1), F.ceil(length / block_tokens))
    row = row.withColumn("_from", F.pmod(F.xxhash64("rank", "shard", F.lit(seed + 2)), blocks) * block_tokens)
    end, start, to = F.col("_end"), F.col("_end") - F.col("size"), F.col("_from") + F.col("_rest")
    direct = F.greatest(F.lit(0), F.least(end, to) - F.greatest(start, F.col("_from")))
    wrapped = F.greatest(F.lit(0), F.least(end, to - length) - start)
    taken = F.col("_passes") * F.col("size") + direct + wrapped
    made_of = [F.col("_passes"), F.greatest(F.lit(0), F.col("_from") - start), direct, wrapped]
    return row.select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(c.cast("long").alias(n) for c, n in zip(made_of, PARTS, strict=True) if parts)
    )
