"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A sketch has ``bands * rows`` coordinates. In round r < t every element falls in
one bin, chosen by that round's hash, and leaves r and a hash; a bin keeps its
least value. In rounds t to 2t - 1 all elements fall in bin r - t, so every bin
is filled; large sets need one round or two. Two coordinates agree with
probability equal to the Jaccard similarity, as concentrated as for minwise hashing.

Texts with equal sets form one class; only classes are compared. Each class meets
one leader first, the smallest class over its bands, and links join components. As
long as a band's bucket holds several components it has a leader drawn anew; a class
meets one of its buckets' leaders a turn, and two components meet in one pair. What
the turns have not settled is compared in full: small buckets pair by pair, larger
ones in blocks of bounded rows and elements, the members of the bucket's largest
component with the others and those among themselves; a product of the blocks'
incidence matrices gives all intersections at once and only the links that join
components leave the task. So no pair is dropped by a cap, no task holds more than
two blocks, and a group of copies costs one comparison a copy. Every link is
confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, map_batches, materialize, mix64, release, shingle_sets
from .components import connected_components, forest

#: Members up to which an open bucket is compared pair by pair; beyond, set elements and rows of a block, and columns of its matrix.
_SMALL, _BLOCK, _ROWS, _COLUMNS = 8, 150_000, 1024, 4096
#: Bytes of text whose words are hashed at once.
_TOGETHER = 500_000
#: Pairs up to which no class can have very many; pairs of a class beyond which its set is sent to several tasks; classes of that kind whose ids are broadcast.
_FEW_PAIRS, _HOT_PAIRS, _HOT_CLASSES = 20_000, 500, 200_000


def sketch(elements: np.ndarray, coordinates: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of distinct 64-bit hashes."""
    t, n = np.uint64(coordinates), len(elements)
    full = np.uint64(2**64 - 1)
    out = np.full(coordinates, full)
    together = max(1, min(coordinates, -(-9 * coordinates // n)))  # rounds at once: about enough to fill all bins
    for r in range(0, coordinates, together):
        rounds = np.arange(r, min(r + together, coordinates), dtype=np.uint64)
        h = mix64(elements[None, :] ^ mix64(rounds, 31)[:, None])
        value = (rounds[:, None] << np.uint64(52)) | (h & np.uint64(2**52 - 1))
        place = ((h >> np.uint64(32)) * t) >> np.uint64(32)
        np.minimum.at(out, place.ravel().astype(np.int64), value.ravel())
        if (out != full).all():
            return out
    for empty in np.flatnonzero(out == full).tolist():
        r = coordinates + empty
        h = mix64(elements ^ mix64(np.array([r], dtype=np.uint64), 31))
        out[empty] = (np.uint64(r) << np.uint64(52)) | (h & np.uint64(2**52 - 1)).min()
    return out


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band's coordinates, different for different bands; sketches are rows."""
    rows = coordinates.reshape(len(coordinates), bands, -1)
    key = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64), 41), rows.shape[:2])
    for j in range(rows.shape[2]):
        key = mix64(key, 43) + rows[:, :, j]
    return mix64(key, 47).view(np.int64)


def _word_sets(hashed: WordHasher, texts: pa.Array, words: int) -> Iterator[list[np.ndarray]]:
    """Distinct shingle hashes of whole texts, their words ASCII lower-cased; empty without words. Some texts at a time."""
    waiting, size = [], 0
    for text in texts:
        waiting.append((text.as_py() or "").encode().lower())
        size += len(waiting[-1])
        if size > _TOGETHER or len(waiting) == 256:
            yield shingle_sets(*hashed.many(waiting), words)
            waiting, size = [], 0
    if waiting:
        yield shingle_sets(*hashed.many(waiting), words)


def _sketched(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHasher()
        for batch in batches:
            n, prints, keys, has = [], [], [], []
            for found in _word_sets(hashed, batch.column(1), words):
                n += [len(f) for f in found]
                prints += [blake2b(f.tobytes(), digest_size=16).digest() for f in found]
                has += [len(f) > 0 for f in found]
                some = [sketch(f, bands * rows) for f in found if len(f)]
                if some:
                    keys.append(band_keys(np.stack(some), bands).ravel())
            both = np.frombuffer(b"".join(prints), dtype="<i8").reshape(-1, 2)
            ends = np.cumsum([0, *has]) * bands
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), lists], schema=schema)

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def _sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(rep, elements) of the chosen documents: sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHasher()
        for batch in batches:
            at = 0
            for found in _word_sets(hashed, batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), pa.array([f.tobytes() for f in found], pa.binary())], names=["rep", "elements"])
                at += len(found)

    picked = docs.select("doc_id", "text").join(chosen.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    return map_batches(picked, run, "rep long, elements binary")


def _sent(pairs: DataFrame, sets: DataFrame, end: str, hot: DataFrame | None) -> DataFrame:
    """The pairs with the set of their class ``end`` as _set; one of very many pairs (``hot``) has its set at several tasks."""
    if hot is None:
        return pairs.join(sets.select(F.col("rep").alias(end), F.col("elements").alias("_set")), end)
    hot = F.broadcast(hot.filter(F.col("end") == end).select("_hot", "_parts"))
    other = "b" if end == "a" else "a"
    left = pairs.join(hot, F.col(end) == F.col("_hot"), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(other), F.col("_parts")), F.lit(0)).cast("int"))
    right = sets.join(hot, F.col("rep") == F.col("_hot"), "left").select(
        F.col("rep").alias(end), F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"), F.col("elements").alias("_set")
    )
    return left.drop("_hot", "_parts").join(right, [end, "_part"]).drop("_part")


def _hot(pairs: DataFrame) -> DataFrame | None:
    """(end, _hot, _parts): the classes of very many pairs and the number of tasks for each, None if there are none."""
    if pairs.count() <= _FEW_PAIRS:
        return None
    ends = pairs.select(F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("a").alias("_hot")), F.struct(F.lit("b").alias("end"), F.col("b").alias("_hot")))).alias("_e"))
    many = ends.groupBy("_e.end", "_e._hot").agg(F.ceil(F.count(F.lit(1)) / _HOT_PAIRS).cast("int").alias("_parts")).filter("_parts > 1")
    hot = materialize(many, "near-hot")
    return hot if 0 < hot.count() <= _HOT_CLASSES else None  # so many hot classes leave none with more than a small share


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, held: list[DataFrame]) -> DataFrame:
    """The distinct pairs (a, b, ca, cb) whose full sets meet 100 * intersection >= percent * union; ca, cb: their components.

    ``held`` takes the tables that the result reads.
    """
    pairs = materialize(pairs, "near-pairs")
    hot = _hot(pairs)
    held += [pairs] if hot is None else [pairs, hot]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:4]], names=["a", "b", "ca", "cb"])

    both = _sent(_sent(pairs, sets, "a", hot).withColumnRenamed("_set", "_one"), sets, "b", hot).select("a", "b", "ca", "cb", "_one", "_set")
    return map_batches(both, run, "a long, b long, ca long, cb long")


def _blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, ca, cb) that join components within the buckets of ``members``, found block by block.

    ``members``: key, rep, component, and of its bucket _main (the largest component),
    _others and _others_size (members outside it and their elements), _all and _size.
    Blocks 0 to p - 1 have the others, the next q those of the largest component.
    """
    pieces = lambda rows, size: F.greatest(F.ceil(size / _BLOCK), F.ceil(rows / _ROWS), F.lit(1)).cast("long")
    p, q = pieces(F.col("_others"), F.col("_others_size")), pieces(F.col("_all") - F.col("_others"), F.col("_size") - F.col("_others_size"))
    draw, main = F.xxhash64("rep", "key"), F.col("component") == F.col("_main")
    dealt = members.withColumn("_p", p).withColumn("_q", q).withColumn("_is_main", main)
    dealt = dealt.withColumn("block", F.when(main, F.col("_p") + F.pmod(draw, F.col("_q"))).otherwise(F.pmod(draw, F.col("_p"))))
    last = F.col("_p") - 1 + F.when(F.col("_is_main"), F.lit(0)).otherwise(F.col("_q"))
    sides = F.transform(
        F.sequence(F.lit(0).cast("long"), last), lambda x: F.struct(F.least("block", x).alias("one"), F.greatest("block", x).alias("two"))
    )
    sent = dealt.withColumn("_pair", F.explode(sides)).select("key", "_pair.one", "_pair.two", "block", "rep", "component")

    def compare(table: pa.Table) -> pa.Table:
        block, rep, component = (table.column(c).to_numpy() for c in ("block", "rep", "component"))
        first, second = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        found = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in table.column("elements")]
        n = np.array([len(f) for f in found])
        values, at, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1  # elements of one set only meet nothing
        use = times[at] > 1
        row, column = np.repeat(np.arange(len(found)), n)[use], shared[at[use]]
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        common = np.zeros((len(left), len(right)), dtype=np.float32)
        for start in range(0, int((times > 1).sum()), _COLUMNS):
            inside = (column >= start) & (column < start + _COLUMNS)
            held = np.zeros((len(found), _COLUMNS), dtype=np.float32)
            held[row[inside], column[inside] - start] = 1
            common += held[left] @ held[right].T
        linked = (100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)) & (component[left][:, None] != component[right][None, :])
        i, j = np.nonzero(linked)
        ca, cb = forest(component[left[i]], component[right[j]]) if len(i) else (rep[:0], rep[:0])
        return pa.table({"a": ca, "b": cb, "ca": ca, "cb": cb})

    joined = sent.join(sets.withColumnRenamed("rep", "_rep"), F.col("rep") == F.col("_rep")).drop("_rep")
    return joined.groupBy("key", "one", "two").applyInArrow(compare, "a long, b long, ca long, cb long")


def near_duplicates(
    docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, leader_rounds: int = 2
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Two documents are linked if their sets of distinct ``words``-word shingles
    have a Jaccard similarity of ``percent`` / 100 or more; a text with fewer words
    is one shingle. component_id is the smallest doc_id reachable by links. Texts
    that are null or have no words, and rows without doc_id, link with nothing.
    Rows that share a doc_id are one document with all their links. Other columns
    are ignored. An empty table gives no rows. A linked pair shares no band with
    probability (1 - s^rows)^bands: 1.3e-7 at a similarity s of 0.8, less above.
    """
    sketched = materialize(_sketched(docs, words, bands, rows), "near-sketches")
    usable = sketched.filter("n > 0 and doc_id is not null")
    classes = materialize(
        usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-classes"
    )
    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    lowest = F.min(F.struct("rep", "n")).alias("lead")
    buckets = banded.groupBy("key").agg(lowest, F.max("rep").alias("hi")).filter("lead.rep < hi").drop("hi")
    members = materialize(banded.join(buckets, "key").withColumn("component", F.col("rep")), "near-members")
    sets = materialize(_sets(docs, members.select("rep").distinct(), words), "near-sets")
    fits = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent

    # Every class meets the smallest leader over its bands.
    first = members.filter((F.col("rep") != F.col("lead.rep")) & fits).groupBy("rep").agg(F.min("lead.rep").alias("a"))
    held: list[DataFrame] = []
    links = _confirmed(first.select("a", F.col("rep").alias("b"), F.col("a").alias("ca"), F.col("rep").alias("cb")), sets, percent, held)
    new = materialize(links, "near-links")
    held.append(new)
    labels = connected_components(new)
    moved, turn = labels.withColumnRenamed("node", "_was").withColumnRenamed("component", "_now"), 0
    while True:
        # The members of buckets that still hold several components.
        current = members.drop("lead").join(moved, F.col("component") == F.col("_was"), "left").withColumn("component", F.coalesce("_now", "component")).drop("_was", "_now")
        drawn = F.max(F.struct(F.xxhash64("rep", "key", F.lit(turn)).alias("h"), "rep", "n", "component")).alias("lead")
        several = current.groupBy("key").agg(drawn, F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low < _high")
        still = materialize(current.join(several.select("key", "lead"), "key"), "near-members")
        release(members)
        members = still
        if not members.limit(1).count():
            break
        last = turn == leader_rounds
        if not last:
            apart = members.filter((F.col("component") != F.col("lead.component")) & fits)
            one = apart.groupBy("rep", "component").agg(F.min(F.struct("lead.h", "lead.rep", "lead.component")).alias("l"))
            ends = one.select("rep", "component", F.col("l.rep").alias("other"), F.col("l.component").alias("others"))
            swap = F.col("component") < F.col("others")
            pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
            ends = ends.select(pick("component", "others").alias("ca"), pick("others", "component").alias("cb"), pick("rep", "other").alias("a"), pick("other", "rep").alias("b"))
            pairs = ends.groupBy("ca", "cb").agg(F.min(F.struct(F.xxhash64("a", "b", F.lit(turn)).alias("h"), "a", "b")).alias("p"))
            found = _confirmed(pairs.select("p.a", "p.b", "ca", "cb"), sets, percent, held)
        else:
            found = _settled(members.drop("lead"), sets, percent, held)
        new = materialize(found, "near-links")
        moved = connected_components(new, "ca", "cb")
        moved = moved.withColumnRenamed("node", "_was").withColumnRenamed("component", "_now")
        every = labels.unionByName(moved.select(F.col("_was").alias("node"), F.col("_was").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        labels = materialize(
            every.join(moved, F.col("component") == F.col("_was"), "left").select("node", F.coalesce("_now", "component").alias("component")), "near-labels"
        )
        held.append(new)
        if last:
            break
        turn += 1
    release(sets, members, *held)
    found = classes.select(F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), "rep").join(labels, F.col("rep") == F.col("node"), "left").select(
        "_f1", "_f2", F.coalesce("component", "rep").alias("_component")
    )
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("f1"))
    out = sketched.select("doc_id", "n", own.alias("f1"), "f2").join(found, (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")), "left")
    component = F.coalesce("_component", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _settled(members: DataFrame, sets: DataFrame, percent: int, held: list[DataFrame]) -> DataFrame:
    """All links (a, b, ca, cb) between components that share a bucket of ``members`` (key, rep, n, component)."""
    count = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    facts = count.groupBy("key").agg(
        F.sum("m").alias("_all"), F.sum("s").alias("_size"), F.max(F.struct("m", "component", "s")).alias("_top")
    ).select(
        "key", "_all", "_size", F.col("_top.component").alias("_main"), (F.col("_all") - F.col("_top.m")).alias("_others"), (F.col("_size") - F.col("_top.s")).alias("_others_size")
    )
    told = members.join(facts, "key")
    small = told.filter(F.col("_all") <= _SMALL)
    two = small.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    pairs = small.select("key", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca")).join(two, "key").filter("a < b and ca <> cb")
    pairs = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "ca", "cb").distinct()
    by_pair = _confirmed(pairs, sets, percent, held)
    return by_pair.unionByName(_blocks(told.filter(F.col("_all") > _SMALL), sets, percent))
