"""Fingerprints of whole texts that follow edit distance: order min-hash, in DataFrame functions only.

A text's symbols are its white-space separated words (long ones in pieces), its k-mers
all runs of k symbols. Equal k-mers of a text are told apart by their occurrence
numbers, so that a repeated passage weighs as often as it occurs. A sketch puts the numbered
k-mers in an order of its own by hash, takes those at the order's two ends (least by the hash
and least by its reverse), brings the two into the order in which the text has them and hashes
the pair. Two texts agree in a sketch if they share both k-mers, in that order.

The k-mers are dealt by hash to parts, each with its own sketches, so that a k-mer meets only
the orders of its part. A part without k-mers has no sketches; texts without words have none.

Everything but the array of a text's k-mers is generated code over exploded places: the
array, hash and place in one number, is sorted, which puts equal k-mers next to each other in
the order of the text; minima and maxima need a few numbers a part, not the k-mers. Nothing of
a text is shuffled but the text itself, once, when documents are put in order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

#: Symbols of a k-mer, code points of a symbol, parts of a fingerprint and sketches of a part.
K, PIECE, PARTS, ORDERS = 3, 12, 8, 4
#: Bits of a packed number that hold the place in the text.
_PLACE_BITS = 31
_PLACES = 2**_PLACE_BITS - 1


def numbered_kmers(texts: DataFrame, keys: list[str], text: str = "text", k: int = K) -> DataFrame:
    """(keys, place, kmer) of every k-mer of every text; kmer is a hash of its symbols and occurrence number.

    Fewer symbols than k are one k-mer. A text without any (null, empty, blank) has one row
    of nulls, so that it keeps its place in what follows. Outer explodes: others would make
    Spark test the arrays' sizes, and so build them, twice.
    """
    none = F.array().cast("array<int>")
    symbols = texts.select(*keys, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{SPACE}]{{1,{PIECE}}}"), F.lit(0)).alias("_symbols"))
    starts = F.when(F.size("_symbols") > 0, F.sequence(F.lit(0), F.greatest(F.size("_symbols") - k, F.lit(0)))).otherwise(none)
    packed = F.transform(
        starts, lambda i: F.shiftleft(F.xxhash64(*(F.get("_symbols", i + j) for j in range(k))), _PLACE_BITS).bitwiseOR(i.cast("long"))
    )
    lists = symbols.select(*keys, F.sort_array(packed).alias("_packed"))
    hash_at = lambda j: F.shiftright(F.get("_packed", j), _PLACE_BITS)
    every = F.when(F.size("_packed") > 0, F.sequence(F.lit(0), F.size("_packed") - 1)).otherwise(none)
    runs = lists.select(*keys, "_packed", F.filter(every, lambda j: (j == 0) | (hash_at(j) != hash_at(j - 1))).alias("_runs"))
    runs = runs.select(*keys, "_packed", "_runs", F.posexplode_outer("_runs").alias("_run", "_first"))
    end = F.coalesce(F.get("_runs", F.col("_run") + 1), F.size("_packed"))
    rows = runs.select(*keys, "_packed", "_first", F.explode_outer(F.sequence("_first", end - 1)).alias("_at"))
    rows = rows.select(*keys, F.get("_packed", "_at").alias("_one"), (F.col("_at") - F.col("_first")).alias("_occurrence"))
    kmer = F.when(F.col("_one").isNotNull(), F.xxhash64(F.shiftright("_one", _PLACE_BITS), "_occurrence"))
    return rows.select(*keys, F.col("_one").bitwiseAND(F.lit(_PLACES)).alias("place"), kmer.alias("kmer"))


def part_sketches(kmers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, sketch_0, sketch_1, ...) from ``numbered_kmers``; part is null for a text without words."""
    places = F.col("place")
    ends = []
    for i in range(ORDERS):
        order = F.xxhash64(F.col("kmer").bitwiseXOR(F.lit((i + 1) * 0x1E3779B97F4A7C15 % 2**63)))
        one = F.shiftleft(order, _PLACE_BITS).bitwiseOR(places)
        ends += [F.min(one).alias(f"_low_{i}"), F.max(one).alias(f"_high_{i}")]
    found = kmers.groupBy(*keys, F.pmod("kmer", F.lit(PARTS)).cast("int").alias("part")).agg(*ends)

    def pair(i: int) -> Column:
        low, high = F.col(f"_low_{i}"), F.col(f"_high_{i}")
        a, b = F.shiftright(low, _PLACE_BITS), F.shiftright(high, _PLACE_BITS)
        before = low.bitwiseAND(F.lit(_PLACES)) <= high.bitwiseAND(F.lit(_PLACES))
        return F.shiftright(F.when(before, F.xxhash64(a, b)).otherwise(F.xxhash64(b, a)), 32).cast("int").alias(f"sketch_{i}")

    return found.select(*keys, "part", *(pair(i) for i in range(ORDERS)))


def sketches(texts: DataFrame, keys: list[str], columns: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, carried, one array of int for each of ``columns``): the sketches of texts in several columns.

    ``keys`` tell rows apart; ``carried`` columns depend on them and come along. Rows that are
    partitioned by some of the keys stay where they are: none of the groupings moves them.
    """
    kept = [*keys, *carried]
    kinds = F.array(*(F.struct(F.lit(n).alias("kind"), F.col(c).alias("text")) for n, c in enumerate(columns)))
    each = texts.select(*kept, F.explode_outer(kinds).alias("_each")).select(*kept, F.col("_each.kind").alias("_kind"), F.col("_each.text").alias("_text"))
    parts = part_sketches(numbered_kmers(each, [*kept, "_kind"], "_text"), [*kept, "_kind"])
    at = lambda n, p, i: F.max(F.when((F.col("_kind") == n) & (F.col("part") == p), F.col(f"sketch_{i}"))).alias(f"_{n}_{p}_{i}")
    places = [(n, p, i) for n in range(len(columns)) for p in range(PARTS) for i in range(ORDERS)]
    wide = parts.groupBy(*kept).agg(*(at(*x) for x in places))
    return wide.select(*kept, *(F.array(*(f"_{n}_{p}_{i}" for m, p, i in places if m == n)).alias(c) for n, c in enumerate(columns)))


def as_text(sketch: str | Column) -> Column:
    """A fingerprint: eight hexadecimal digits a sketch, and as many dashes for one that is not there."""
    array = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.array_join(F.transform(array, lambda x: F.coalesce(F.right(F.lpad(F.lower(F.hex(x)), 16, "0"), F.lit(8)), F.lit("-" * 8))), "")


def likeness(a: str, b: str) -> Column:
    """The share of sketches, of those that either text has, in which both agree; 1 where neither has any."""
    have = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull()))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(have == 0, F.lit(1.0)).otherwise(same / F.greatest(have, F.lit(1)).cast("double"))


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, fingerprint) of every row of ``documents``.

    A null text is as an empty one, whose fingerprint is all dashes; rows with a null or
    repeated key are rows of their own; other columns are ignored; an empty table gives no
    rows. A very long text stands in memory with its k-mers, about thirty times its bytes, in
    one task; equal texts, and texts that differ in white space alone, have equal fingerprints.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_body"))
    found = sketches(rows.withColumn("_n", F.length("_body").cast("long")), ["_row"], ["_body"], ("_key", "_n"))
    return found.select(F.col("_key").alias(key), F.col("_n").alias("n_chars"), as_text("_body").alias("fingerprint"))


# ---------------------------------------------------------------- each document and its successor


def _bounds(rows: DataFrame, n: int, most: int, bucket_rows: int) -> list[tuple]:
    """Keys (_id, _h) that cut the rows in order into buckets of about ``bucket_rows`` rows, from a bounded draw by hash."""
    buckets = min(most, n // bucket_rows)
    if buckets < 2:
        return []
    share = min(1.0, 20 * buckets / n)
    draw = rows.filter(F.pmod(F.xxhash64("_h", "_id"), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select("_id", "_h")
    keys = sorted((tuple(r) for r in draw.limit(40 * most).collect()), key=lambda r: (r[0] is not None, r))
    return sorted({keys[len(keys) * i // buckets] for i in range(1, buckets)}, key=lambda r: (r[0] is not None, r)) if keys else []


def _bucket(bounds: list[tuple], kind: str) -> Column:
    """How many bounds are not above a row's key, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    schema = f"array<struct<_id: {kind}, _h: bigint>>"
    literal = lambda some: F.from_json(F.lit(json.dumps([{"_id": i, "_h": h} for i, h in some])), schema)  # noqa: E731  folded into one constant
    key = F.struct("_id", "_h")
    group = F.size(F.filter(literal(bounds[::step]), lambda b: b <= key))
    inside = F.size(F.filter(F.slice(literal(bounds), F.greatest(group - 1, F.lit(0)) * step + 1, F.lit(step)), lambda b: b <= key))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + inside)


def edited_neighbours(documents: DataFrame, *, max_buckets: int = 20_000, bucket_rows: int = 200) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text is a document's own with the last quarter of its code points (rounded down)
    replaced by the first as many, or all, of the next document's, in ascending order of doc_id;
    the last is followed by the first. A null doc_id comes before all others and rows that share
    one are in the order of a hash of their texts; each is a document. A null text is
    empty. A sole document follows itself; an empty table gives no rows; other columns are ignored.
    A very long text stands in memory with its k-mers, about thirty times its bytes, in one task.

    Rows go, by bounds from a bounded draw of their keys, to at most ``max_buckets`` buckets that
    follow each other in order. Text is shuffled once, by bucket; the rest happens where it lies.
    The last of a bucket is followed by the first of the next, and these at most two rows a
    bucket meet in a small table. Rows alike in doc_id and text are in one bucket.
    """
    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_body")).withColumn("_h", F.xxhash64("_body"))
    rows = rows.withColumn("_bucket", _bucket(_bounds(rows, documents.select(F.count(F.lit(1))).first()[0], max_buckets, bucket_rows), kind))
    order = Window.partitionBy("_bucket").orderBy("_id", "_h")

    # The ends of the buckets, two rows each.
    key = F.struct("_id", "_h")
    ends = {r["_bucket"]: (r["first"], r["last"]) for r in rows.groupBy("_bucket").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()}
    full = sorted(ends)
    following = {b: tuple(ends[full[(i + 1) % len(full)]][0]) for i, b in enumerate(full)}
    wanted = [{"_joint": b, "_role": role, "_id": i, "_h": h} for b in full for role, (i, h) in enumerate((tuple(ends[b][1]), following[b]))]
    schema = f"array<struct<_joint: int, _role: int, _id: {kind}, _h: bigint>>"
    wanted = documents.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(wanted)), schema))).alias("w")  # two keys a bucket
    same = F.col("r._id").eqNullSafe(F.col("w._id")) & (F.col("r._h") == F.col("w._h"))
    held = rows.alias("r").join(F.broadcast(wanted), same).select("_joint", "_role", "_body")
    role = lambda n, name: F.min(F.when(F.col("_role") == n, F.col("_body"))).alias(name)
    meet = held.groupBy("_joint").agg(role(0, "_body"), role(1, "_after"))
    meet = sketches(_edit(meet), ["_joint"], ["_edited", "_after"], ("_sha",))
    meet = F.broadcast(meet.select("_joint", F.col("_edited").alias("_joint_edited"), F.col("_after").alias("_joint_after"), F.col("_sha").alias("_joint_sha")))  # a row of about 400 bytes a bucket

    # All others have their successor in their bucket. The last of a bucket is not edited here.
    placed = rows.withColumns({"_nth": F.row_number().over(order), "_after": F.lead("_body").over(order)})
    placed = _edit(placed).withColumn("_n", F.length("_body").cast("long"))
    keys = ["_bucket", "_nth"]
    found = sketches(placed, keys, ["_body", "_edited"], ("_id", "_n", "_sha"))
    again = Window.partitionBy("_bucket").orderBy("_nth")
    found = found.withColumn("_after", F.lead("_body").over(again)).withColumn("_ends", F.when(F.col("_after").isNull(), F.col("_bucket")))
    found = found.join(meet, F.col("_ends") == F.col("_joint"), "left")
    pick = lambda own, joint: F.when(F.col("_ends").isNull(), F.col(own)).otherwise(F.col(joint))
    found = found.select(
        "_id", "_n", "_body", pick("_sha", "_joint_sha").alias("_sha"), pick("_edited", "_joint_edited").alias("_edited"), pick("_after", "_joint_after").alias("_after")
    )
    return found.select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_chars"), F.col("_sha").alias("edited_sha256"), as_text("_body").alias("fingerprint"),
        as_text("_edited").alias("edited_fingerprint"), likeness("_body", "_edited").alias("near_edited"), likeness("_body", "_after").alias("near_next"),
    )


def _edit(rows: DataFrame) -> DataFrame:
    """With _edited, the text _body whose last quarter gives way to the beginning of _after, and its digest _sha."""
    n = F.length("_body")
    cut = F.floor(n / 4).cast("int")
    edited = F.when(F.col("_after").isNotNull(), F.concat(F.left("_body", n - cut), F.left("_after", cut)))
    return rows.withColumn("_edited", edited).withColumn("_sha", F.sha2(F.col("_edited").cast("binary"), 256))
