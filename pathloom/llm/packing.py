"""Packing of tokenised documents into fixed windows, online with bounded space.

Every partition keeps ``open_windows`` windows. A document's full windows leave
at once; the rest goes to the open window it fits best. Where none fits, the
fullest window is emitted: topped up with the head of the document if more than
``slack`` ids of it would stay empty. At the end the open windows of
``merge_partitions`` neighbouring partitions are merged in a second pass, whose
groups are bounded by open_windows * merge_partitions windows whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .tokens import read_vocabulary, tokenizer

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_RAW = PIECES + ", merge_group long"
_RAW_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    + [("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("merge_group", pa.int64())]
)
#: Bytes of ids that a worker gathers before it hands pieces on.
_FLUSH = 8_000_000


class Windows:
    """A fixed number of open windows; pieces are (doc_id, start, length, ids, doc_tokens)."""

    def __init__(self, size: int, limit: int, slack: int) -> None:
        self.size, self.limit, self.slack = size, limit, slack
        self.open: list[tuple[int, list]] = []  # free ids, pieces

    def add(self, doc_id, start: int, ids: memoryview, total: int) -> Iterator[list]:
        """Place a document's piece; yields the windows that this closes."""
        done, n = 0, len(ids) // 4
        cut = lambda a, b: (doc_id, start + a, b - a, bytes(ids[4 * a : 4 * b]), total)
        while n - done >= self.size:
            yield [cut(done, done + self.size)]
            done += self.size
        while done < n:
            need = n - done
            best = min((i for i, w in enumerate(self.open) if w[0] >= need), key=lambda i: self.open[i][0], default=None)
            if best is None and len(self.open) < self.limit:
                self.open.append((self.size, []))
                best = len(self.open) - 1
            if best is None:
                free, pieces = self.open.pop(min(range(len(self.open)), key=lambda i: self.open[i][0]))
                if free > self.slack:
                    pieces.append(cut(done, done + free))
                    done += free
                yield pieces
                continue
            free, pieces = self.open[best]
            pieces.append(cut(done, n))
            done = n
            if free == need:
                self.open.pop(best)
                yield pieces
            else:
                self.open[best] = (free - need, pieces)


def _rows(windows: list[list], first: int, group: int | None) -> Iterator[tuple]:
    for k, pieces in enumerate(windows):
        at = 0
        for doc_id, start, length, ids, total in pieces:
            yield doc_id, start, length, ids, total, first + k, at, group
            at += length


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _RAW_ARROW, strict=True)], schema=_RAW_ARROW
    )


def tokenized(docs: DataFrame, vocabulary_path: str, end_id: int | None = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, *keep) of all documents; a null text is the end id alone."""
    from .common import map_rows

    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def make():
        encode = tokenizer(vocabulary.value, end_id).encode
        return lambda c: {k: v for k, v in c.items() if k != "text"} | {"ids": [encode(t) for t in c["text"]]}

    types = dict(docs.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in ("doc_id", *keep)] + ["ids binary"])
    return map_rows(docs.select("doc_id", *keep, "text"), make, schema)


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    *,
    length: int = 2048,
    end_id: int | None = 1,
    open_windows: int = 16,
    merge_partitions: int = 16,
    slack: int = 16,
) -> DataFrame:
    """Pieces of all documents with their ids and places: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty
    text is its end id alone. Rows that repeat a doc_id are documents of their
    own. A null doc_id stays null. An empty table gives no pieces.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary.value, end_id).encode
        task = TaskContext.get().partitionId()
        windows, count, rows, held = Windows(length, open_windows, slack), task << 32, [], 0
        for batch in batches:
            for doc_id, text in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                ids = memoryview(encode(text.as_py()))
                for pieces in windows.add(doc_id.as_py(), 0, ids, len(ids) // 4):
                    rows += _rows([pieces], count, None)
                    count += 1
                    held += 4 * length
                if held > _FLUSH:
                    yield _batch(rows)
                    rows, held = [], 0
        rows += _rows([p for _, p in windows.open], count, task // merge_partitions)
        if rows:
            yield _batch(rows)

    placed = map_batches(docs.select("doc_id", "text"), place, _RAW, keeps=True)
    placed = materialize(placed.withColumn("open", F.col("merge_group").isNotNull()), "packing", ["open"])

    def merge(table: pa.Table) -> pa.Table:
        group = table.column("merge_group")[0].as_py()
        pieces = sorted(
            zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids", "doc_tokens")), strict=True),
            key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1]),
        )
        windows = Windows(length, len(pieces), slack)
        full = [w for p in pieces for w in windows.add(p[0], p[1], memoryview(p[3]), p[4])]
        full += [w for free, w in windows.open if free <= slack]
        # what stays partly empty is cut to fill windows one after the other
        rest = Windows(length, 1, 0)
        for p in [p for free, w in sorted(windows.open, key=lambda w: w[0]) if free > slack for p in w]:
            full += rest.add(p[0], p[1], memoryview(p[3]), p[4])
        full += [w for _, w in rest.open]
        return pa.Table.from_batches([_batch(list(_rows(full, (1 << 62) + (group << 32), group)))])

    columns = [c.split()[0] for c in PIECES.split(", ")]
    left = placed.filter("open").drop("open").groupBy("merge_group").applyInArrow(merge, _RAW)
    return placed.filter("not open").select(*columns).unionByName(left.select(*columns))


def padded_share(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """One row: sequences, ids, and the share of padding if all sequences are padded to ``length``."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    total = F.coalesce(F.sum("used"), F.lit(0))
    return used.agg(
        F.count(F.lit(1)).alias("sequences"), total.alias("ids"), (1 - total / (F.count(F.lit(1)) * length)).alias("padding")
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), each gapless from offset 0."""

    def join(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("offset").to_numpy())
        ids = table.column("ids").to_pylist()
        return pa.table({"sequence_id": table.column("sequence_id").slice(0, 1), "ids": [b"".join(ids[i] for i in order)]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids binary")
