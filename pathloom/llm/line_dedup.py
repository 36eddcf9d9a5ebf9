"""Line deduplication that can take documents in and out again.

The exact state is a reference table: one row for each (line key, document),
and from it one row for each key that at least two documents hold, with the
number of documents and the smallest of them, the keeper. Sharded cuckoo filters
hold the latter keys. A pass over documents asks the filters first, by a broadcast
of checked size or shard by shard, so that only lines that may be shared travel to the
exact table; it alone decides. Insertions add a table of references and deletions a
table of ids; ``compact`` writes the references as one table again.

A key is 128 bits of a hash of the stripped, ASCII-lower-cased line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_rows, materialize, release
from .cuckoo import CuckooFilter

_SPACES = b" \t\n\x0b\x0c\r"
#: Keys in a shard's filter, bytes of all filters up to which they are broadcast, and references that one task asks a filter for, about.
SHARD_KEYS = 100_000
_FEW_IDS = 1_000_000
BROADCAST_BYTES = 64_000_000
ASKED_TOGETHER = 500_000


def line_key(line: str, min_chars: int = 10) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    bare = line.encode().strip(_SPACES).lower()
    if len(bare) < min_chars or (len(bare) < 4 * min_chars and len(bare.decode()) < min_chars):
        return None
    return blake2b(bare, digest_size=16).digest()


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def references(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row (k1, k2, doc_id) for each document and distinct counted line; null ids hold none."""
    schema = "k1 long, k2 long, doc_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                mine = {k for line in (text.as_py() or "").split("\n") if (k := line_key(line, min_chars))}
                keys += mine
                owners += [doc_id.as_py()] * len(mine)
            k1, k2 = _halves(keys)
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(owners, pa.int64())], names=["k1", "k2", "doc_id"])

    found = map_batches(docs.filter("doc_id is not null").select("doc_id", "text"), run, schema)
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    if not again.limit(1).count():
        return found
    # Rows that share a doc_id are one document: each of its lines counts once.
    several = F.broadcast(again) if again.limit(_FEW_IDS + 1).count() <= _FEW_IDS else again
    return found.join(several, "doc_id", "left_anti").select("k1", "k2", "doc_id").unionByName(found.join(several, "doc_id", "left_semi").select("k1", "k2", "doc_id").distinct())


def _shared_keys(refs: DataFrame) -> DataFrame:
    """Keys of at least two documents: (k1, k2, n_docs, keeper)."""
    one = refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("keeper"))
    return one.filter("n_docs > 1")


@dataclass
class LineIndex:
    """The state; every change makes a new one and leaves the old one valid.

    ``tables``: the written tables that ``refs`` reads, which later states read, too.
    """

    refs: DataFrame
    shared: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int
    tables: tuple[DataFrame, ...] = ()

    @classmethod
    def build(cls, docs: DataFrame, *, min_chars: int = 10) -> LineIndex:
        refs = materialize(references(docs, min_chars), "line-refs")
        shared = materialize(_shared_keys(refs), "line-shared")
        shards = max(1, -(-shared.count() // SHARD_KEYS))

        def fill(table: pa.Table) -> pa.Table:
            made = CuckooFilter.of(table.column("k1").to_numpy() ^ (table.column("k2").to_numpy() << 1))
            return pa.table({"shard": table.column("shard").slice(0, 1), "cells": [made.dump()]})

        keyed = shared.select("k1", "k2", F.pmod("k2", F.lit(shards)).alias("shard"))
        filters = keyed.groupBy("shard").applyInArrow(fill, "shard long, cells binary")
        return cls(refs, shared, materialize(filters, "line-filters"), shards, min_chars, (refs,))

    def _changed(self, refs: DataFrame, touched: DataFrame, *tables: DataFrame) -> LineIndex:
        """The state with other references; ``touched`` has the keys whose counts may differ, ``tables`` what was written for it."""
        touched = touched.select("k1", "k2").distinct()
        now = _shared_keys(refs.join(touched, ["k1", "k2"], "left_semi"))
        shared = materialize(self.shared.join(touched, ["k1", "k2"], "left_anti").unionByName(now), "line-shared")
        key = ["k1", "k2"]
        came = shared.join(self.shared, key, "left_anti").select(*key, F.lit(1).alias("step"))
        went = self.shared.join(shared, key, "left_anti").select(*key, F.lit(-1).alias("step"))
        steps = came.unionByName(went).withColumn("shard", F.pmod("k2", F.lit(self.shards)))
        current = shared.select(*key, F.lit(0).alias("step"), F.pmod("k2", F.lit(self.shards)).alias("shard"))
        steps = steps.unionByName(current.join(steps.select("shard").distinct(), "shard", "left_semi"))

        def update(old: pa.Table, new: pa.Table) -> pa.Table:
            shard = (new if new.num_rows else old).column("shard")[0].as_py()
            if not new.num_rows:
                return pa.table({"shard": [shard], "cells": [old.column("cells")[0].as_py()]})
            step = new.column("step").to_numpy()
            keys = new.column("k1").to_numpy() ^ (new.column("k2").to_numpy() << 1)
            made = CuckooFilter.load(old.column("cells")[0].as_py()) if old.num_rows else CuckooFilter.sized(len(keys))
            made.remove(keys[step < 0])
            if not made.add(keys[step > 0]):  # too full: made anew from the exact table
                made = CuckooFilter.of(keys[step == 0])
            return pa.table({"shard": [shard], "cells": [made.dump()]})

        filters = self.filters.groupBy("shard").cogroup(steps.groupBy("shard")).applyInArrow(update, "shard long, cells binary")
        return LineIndex(refs, shared, materialize(filters, "line-filters"), self.shards, self.min_chars, (*self.tables, *tables))

    def insert(self, docs: DataFrame) -> LineIndex:
        """Take in documents; of those that are in already, the lines that they did not have."""
        new = references(docs, self.min_chars).join(self.refs, ["k1", "k2", "doc_id"], "left_anti")
        new = materialize(new, "line-new")
        return self._changed(self.refs.unionByName(new), new, new)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take out the documents of a doc_id column; their lines' keepers and counts go back. Unknown and null ids change nothing."""
        gone = materialize(doc_ids.select("doc_id").filter("doc_id is not null").distinct(), "line-gone")
        left_out = F.broadcast(gone) if gone.limit(_FEW_IDS + 1).count() <= _FEW_IDS else gone
        return self._changed(self.refs.join(left_out, "doc_id", "left_anti").select("k1", "k2", "doc_id"), self.refs.join(left_out, "doc_id", "left_semi"), gone)

    def compact(self) -> LineIndex:
        """The same state with its references in one table."""
        refs = materialize(self.refs, "line-refs")
        return LineIndex(refs, self.shared, self.filters, self.shards, self.min_chars, (refs,))

    def _suspects(self, docs: DataFrame) -> DataFrame:
        """References of ``docs`` that may be shared lines: those that the filters don't rule out."""
        refs, shards = references(docs, self.min_chars), self.shards
        schema = "k1 long, k2 long, doc_id long"
        size = self.filters.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0)).alias("n")).first()["n"]
        if size > BROADCAST_BYTES:
            return self._suspects_by_shard(refs).select("k1", "k2", "doc_id")
        cells = docs.sparkSession.sparkContext.broadcast({r.shard: r.cells for r in self.filters.collect()})

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = {s: CuckooFilter.load(c) for s, c in cells.value.items()}
            for batch in batches:
                k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
                shard, key = k2 % shards, k1 ^ (k2 << 1)
                may = np.zeros(len(k1), dtype=bool)
                for s in np.unique(shard).tolist():
                    if s in loaded:
                        mine = shard == s
                        may[mine] = loaded[s].has(key[mine])
                yield batch.filter(pa.array(may))

        return map_batches(refs, ask, schema)

    def _suspects_by_shard(self, refs: DataFrame) -> DataFrame:
        """``_suspects`` where the filters are too large for a broadcast: references meet their shard's filter.

        A filter is sent to as many tasks as its references need; they are dealt by
        document, so that one line of very many documents is spread as well.
        """
        refs = materialize(refs, "line-asked")
        turns = max(1, -(-refs.count() // (self.shards * ASKED_TOGETHER)))
        shard, turn = F.pmod("k2", F.lit(self.shards)).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(turns)).alias("turn")
        sent = self.filters.select("shard", "cells", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"))

        def ask(refs: pa.Table, filters: pa.Table) -> pa.Table:
            if not filters.num_rows or not refs.num_rows:
                return refs.slice(0, 0)
            held = CuckooFilter.load(filters.column("cells")[0].as_py())
            keys = refs.column("k1").to_numpy() ^ (refs.column("k2").to_numpy() << 1)
            return refs.filter(pa.array(held.has(keys)))

        both = refs.select("k1", "k2", "doc_id", shard, turn).groupBy("shard", "turn").cogroup(sent.groupBy("shard", "turn"))
        return both.applyInArrow(ask, "k1 long, k2 long, doc_id long, shard long, turn long")

    def apply(self, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """(doc_id, *keep, text, n_lines, n_dropped) of all rows of ``docs``, without repeated lines.

        A counted line stays only in the smallest doc_id that holds it, there as
        often as it occurs; other lines stay, joined by newlines. A null text is
        one empty line and comes back empty. Rows without doc_id are unchanged.
        Rows that share a doc_id are one holder of their lines. An empty table gives no
        rows; columns outside ``keep`` are ignored, and ``keep`` may not name an output.
        """
        if clash := {"text", "n_lines", "n_dropped", "_drops", "_k1", "_k2", "_doc"} & set(keep):
            raise ValueError(f"columns to keep have names of outputs: {sorted(clash)}")
        hits = self._suspects(docs).join(self.shared, ["k1", "k2"]).filter("doc_id <> keeper")
        drops = hits.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("_drops"))
        types = dict(docs.dtypes)
        joined = docs.select("doc_id", *keep, "text").join(
            drops.select(F.col("doc_id").alias("_doc"), F.expr("transform(_drops, x -> x.k1)").alias("_k1"), F.expr("transform(_drops, x -> x.k2)").alias("_k2")),
            F.col("doc_id") == F.col("_doc"), "left",
        ).drop("_doc")
        min_chars = self.min_chars

        def make():
            def work(c):
                out = {k: c[k] for k in ("doc_id", *keep)} | {"text": [], "n_lines": [], "n_dropped": []}
                for text, k1, k2 in zip(c["text"], c["_k1"], c["_k2"], strict=True):
                    lines = (text or "").split("\n")
                    left = lines
                    if k1:
                        both = np.array([k1, k2], dtype="<i8").T.tobytes()
                        drop = {both[i : i + 16] for i in range(0, len(both), 16)}
                        left = [line for line in lines if line_key(line, min_chars) not in drop]
                    out["text"].append("\n".join(left))
                    out["n_lines"].append(len(lines))
                    out["n_dropped"].append(len(lines) - len(left))
                return out

            return work

        schema = ", ".join([f"`{k}` {types[k]}" for k in ("doc_id", *keep)] + ["text string, n_lines long, n_dropped long"])
        return map_rows(joined, make, schema)

    def release(self) -> None:
        """Delete this state's tables and those it shares with the states it came from; no result may read them any more."""
        release(self.shared, self.filters, *self.tables)


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """All documents without the lines that a smaller doc_id holds; see ``LineIndex.apply``."""
    index = LineIndex.build(docs, min_chars=min_chars)
    return index.apply(docs, keep)
