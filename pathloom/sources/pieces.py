"""Large files in pieces: lines with their numbers, and CSV records, read by as many tasks as a file has splits.

Spark's text reader cuts a file at line ends into the splits it deals to tasks. A first pass
makes a small table, a row a split, of what a later split has to know of those before it (how many
lines, records and paths; in CSV whether a quoted cell is open). Sums and states are carried
along each file's row of splits, and a second pass works on every split from there. No whole file
is in a row, and no line is shuffled.

Both passes plan the same splits: these depend on the files and on
spark.sql.files.maxPartitionBytes alone, which must not change between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WS
from ..operators.trees import _FIELDS, _TRIMMED, WHITE, bounded, extract_tree, path_type, strict
from .documents import language_of_file, scan_files
from .sinks import settled

#: Splits up to which their table (a few numbers a row) is sent to all tasks; 128 TB at Spark's usual size of a split.
_FEW_SPLITS = 1_000_000
#: Names of files that cannot be cut, which the driver passes on.
_MOST_WHOLE = 100_000


def _splits(spark: SparkSession, path: str | list[str], glob: str | None, recursive: bool) -> DataFrame:
    """(doc_id, uri, _block, _place, text): lines with the split that holds them, in order within it."""
    reader = spark.read.option("recursiveFileLookup", recursive).option("lineSep", "\n")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    uri, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return files.select(F.xxhash64(uri).alias("doc_id"), uri.alias("uri"), block.alias("_block"), F.monotonically_increasing_id().alias("_place"), F.col("value").alias("text"))


def _with_table(lines: DataFrame, table: DataFrame, *, ordered: bool = False) -> DataFrame:
    """Lines joined with the table of their splits; few splits are broadcast, so that lines stay where they are."""
    key = ["doc_id", "_block"]
    if table.limit(_FEW_SPLITS + 1).count() <= _FEW_SPLITS:
        return lines.join(F.broadcast(table), key)
    joined = lines.join(table, key)
    return joined.repartition(*key).sortWithinPartitions(*key, "_place") if ordered else joined


def _bases(rows: DataFrame, place: str, base: str) -> DataFrame:
    """(doc_id, _block, first place, rows of the file before this split) of counted rows."""
    counted = rows.groupBy("doc_id", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias(f"{base}_first"))
    before = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # the splits of one file
    return counted.select("doc_id", "_block", f"{base}_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base))


def scan_lines(spark: SparkSession, path: str | list[str], *, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(doc_id, uri, language_id, line, text): the lines of files, numbered from 1, read split by split.

    Lines end at ``\\n``; carriage returns stay. An empty last line is none. doc_id is a hash of the uri,
    as in ``scan_files``. The reader leaves out a byte order mark at the start of a file.
    """
    return _numbered(_splits(spark, path, glob, recursive)).select("doc_id", "uri", language_of_file("uri").alias("language_id"), "line", "text")


def _numbered(lines: DataFrame) -> DataFrame:
    joined = _with_table(lines, _bases(lines.select("doc_id", "_block", "_place"), "_place", "_lines"))
    return joined.withColumn("line", (F.col("_lines") + F.col("_place") - F.col("_lines_first") + 1).cast("int"))


def extract_lines(spark: SparkSession, path: str | list[str], *, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(doc_id, ordinal, value, path_type, line, column, context) of html, css, script and environment files, read split by split.

    The rows are those of ``extract`` over whole files. Files of other formats have none here: CSV has
    ``extract_csv_files``, trees need their whole texts. The first pass counts lines and paths, so
    lines are matched twice; a line alone is held in memory.
    """
    from ..plans.engine import native_paths

    lines = _splits(spark, path, glob, recursive).withColumn("language_id", language_of_file("uri"))
    found = lines.select("doc_id", "_block", "_place", F.explode_outer(native_paths("language_id", "text")).alias("_path")).filter(F.col("_path").isNotNull())
    found = found.withColumn("_found", F.monotonically_increasing_id())
    table = _bases(lines.select("doc_id", "_block", "_place"), "_place", "_lines").join(_bases(found.select("doc_id", "_block", "_found"), "_found", "_paths"), ["doc_id", "_block"])
    joined = _with_table(found, table)
    line, ordinal = F.col("_lines") + F.col("_place") - F.col("_lines_first") + 1, F.col("_paths") + F.col("_found") - F.col("_paths_first")
    return joined.select("doc_id", ordinal.cast("int").alias("ordinal"), "_path.value", "_path.path_type", line.cast("int").alias("line"), "_path.column", "_path.context")


# ------------------------------------------------------------------------- csv

_BLANK = " \t\f"
_INNER = re.compile(f"[{WS}\"]")


def summed(text: str) -> str | None:
    """What a stretch of a quoted cell tells of its value: blank "", a word, or None if no path can be made of it."""
    word = text.strip(WHITE)
    return None if _INNER.search(word) else word


def met(a: str | None, b: str | None) -> str | None:
    """Two stretches with a line end between: paths have no white space inside, so one of them must be blank."""
    return b if a == "" else a if b == "" else None


class Reader:
    """The records of comma-separated text, line by line, from any state between two lines.

    ``records``, ``col``: complete records, and complete cells of the one at hand; ``held``: what an open
    quoted cell holds so far, if ``open``. ``void``: an open quote turned out to be none, so that the text must
    be read in one. ``first``: the reader still stands in the record, and ``unclosed`` the cell, with which it began.
    """

    def __init__(self, records: int = 0, col: int = 0, opened: bool = False, held: str | None = "") -> None:
        self.records, self.col, self.open, self.held, self.quoted = records, col, opened, held, opened
        self.void, self.first, self.unclosed, self.head, self.paths = False, True, opened, None, 0

    def line(self, text: str) -> Iterator[tuple[str, int, int, str]]:
        at, size = 0, len(text)
        while not self.void:
            start, value, cell = at, None, None
            if not self.open:
                while at < size and text[at] in _BLANK:
                    at += 1
            if self.open or (at < size and text[at] == '"'):
                begin = at if self.open else at + 1
                close = self._closing(text, begin)
                if close < 0:
                    self.held, self.open = (met(self.held, summed(text[begin:])) if self.open else summed(text[begin:])), True
                    return
                after = close + 1
                while after < size and text[after] in _BLANK:
                    after += 1
                if after == size or text[after] == ",":
                    value = met(self.held, summed(text[begin:close])) if self.open else summed(text[begin:close])
                    if self.unclosed:
                        self.head, value = value if value is not None else "\0", None
                        self.unclosed = False
                    cell, at, self.quoted = "x", after, True
                elif self.open:
                    self.void = True
                    return
                self.open = False
            if cell is None:
                stop = text.find(",", at)
                stop = size if stop < 0 else stop
                cell, at = text[start:stop].strip(_TRIMMED), stop
                value = cell.strip(WHITE)
            if value and ("/" in value or "." in value or "\\" in value) and strict(value):
                self.paths += 1
                yield value, self.records + 1, self.col + 1, f"CSV cell [{self.records + 1},{self.col + 1}]"
            if at < size:
                self.col, at = self.col + 1, at + 1
                continue
            if self.col or self.quoted or cell:
                self.records += 1
            self.col, self.quoted, self.first = 0, False, False
            return

    @staticmethod
    def _closing(text: str, at: int) -> int:
        while True:
            close = text.find('"', at)
            if close < 0 or text[close + 1 : close + 2] != '"':
                return close
            at = close + 2


_SUMMARY = ", ".join(
    ["doc_id long", "_block long", "uri string", "crlf long", "plain long", "odd boolean"]
    + [f"{s}_{c}" for s in ("out", "in") for c in ("records long", "col long", "open boolean", "held string", "void boolean", "first boolean", "unclosed boolean", "head string", "paths long")]
)


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(the first ``columns`` values, the texts) of consecutive rows of one split; a new row of values at each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_pylist() for i in range(columns)]
        texts, begin = batch.column(columns).to_pylist(), 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or (keys[0][i], keys[1][i]) != (keys[0][begin], keys[1][begin]):
                yield tuple(k[begin] for k in keys), iter(texts[begin:i])
                begin = i


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What reading each split does, begun between two records and begun inside a quoted cell."""
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _SUMMARY.split(", "))])
    at, told = None, None

    def row() -> pa.RecordBatch:
        states = [v for r in told[2] for v in (r.records, r.col, r.open, r.held, r.void, r.first, r.unclosed, r.head, r.paths)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([at[0], at[1], at[2], *told[0], told[1], *states], schema, strict=True)], schema=schema)

    for key, texts in _runs(batches, 3):
        if at is None or key[:2] != at[:2]:
            if at is not None:
                yield row()
            at, told = key, [[0, 0], False, (Reader(), Reader(opened=True))]
        for text in texts:
            crlf = text.endswith("\r")
            told[0][0 if crlf else 1] += 1
            text = text.removesuffix("\r")
            told[1] |= "\r" in text
            for reader in told[2]:
                for _ in reader.line(text):
                    pass
    if at is not None:
        yield row()


def _carried(splits: pd.DataFrame) -> pd.DataFrame:
    """The state in which each split of one file begins; ``whole`` if the file has to be read in one."""
    splits = splits.sort_values("_block").reset_index(drop=True)
    last, crlf, plain = len(splits) - 1, splits["crlf"].sum(), splits["plain"].sum()
    # A last line without an end is plain in any file.
    whole = bool(splits["odd"].any() or (crlf and plain > 1) or (crlf and plain == 1 and not splits["plain"][last]))
    out, state, paths = [], (0, 0, False, ""), 0
    for row in splits.to_dict("records"):
        records, col, opened, held = state
        out.append((row["doc_id"], row["_block"], row["uri"], records, col, opened, held, paths))
        side = "in_" if opened else "out_"
        whole |= bool(row[side + "void"])
        paths += int(row[side + "paths"])
        if opened and not row["in_unclosed"]:
            head = row["in_head"]
            value = None if head == "\0" else met(held, head)
            paths += bool(value and strict(value))
        end_held = met(held, row["in_held"]) if opened and row["in_unclosed"] else row[side + "held"]
        state = (records + int(row[side + "records"]), (col if opened and row["in_first"] else 0) + int(row[side + "col"]), bool(row[side + "open"]), end_held)
    whole |= state[2]  # a quote that stays open
    table = pd.DataFrame(out, columns=["doc_id", "_block", "uri", "_records", "_col", "_open", "_held", "_paths"])
    table["_whole"] = whole
    return table


_STATE = "doc_id long, _block long, uri string, _records long, _col long, _open boolean, _held string, _paths long, _whole boolean"


def _paths_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, reader, ordinal = None, None, 0
    for key, texts in _runs(batches, 7):
        if at != key[:2]:
            at, ordinal = key[:2], key[6]
            reader = Reader(key[2], key[3], key[4], key[5])
            reader.unclosed = False
        rows = [r for text in texts for r in reader.line(text.removesuffix("\r"))]
        if rows:
            values = [(n, v, path_type(v), line, col, context) for n, (v, line, col, context) in enumerate(rows, ordinal)]
            ordinal += len(rows)
            arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*values, strict=True), _FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows), pa.int64()), *arrays], names=["doc_id", *(n for n, _ in _FIELDS)])


def extract_csv_files(spark: SparkSession, path: str | list[str], *, glob: str | None = "*.csv", recursive: bool = True) -> DataFrame:
    """(doc_id, ordinal, value, path_type, line, column, context) of CSV files, read split by split; ``line`` is the record.

    The rows are those of ``extract_tree`` over whole files. Every split is read from both states in
    which it can begin; which one it is, and the numbers of its first record, cell and path, follow from
    those before it, file by file. Files that cannot be cut are read whole, as before: those
    with mixed line ends or single carriage returns, those in which a quote that spans splits turns out to be none, and
    those whose last quote never ends, which have no paths.
    """
    lines = bounded(_splits(spark, path, glob, recursive))
    summaries = lines.select("doc_id", "_block", "uri", "text").mapInArrow(_summaries, _SUMMARY)
    table = settled(summaries.groupBy("doc_id").applyInPandas(_carried, _STATE))  # a row a split; a file's splits in a group
    apart = [r["uri"] for r in table.filter("_whole").select("uri").distinct().limit(_MOST_WHOLE + 1).collect()]
    if len(apart) > _MOST_WHOLE:
        raise ValueError(f"more than {_MOST_WHOLE} files cannot be cut; read them with scan_files")
    state = ["_records", "_col", "_open", "_held", "_paths"]
    joined = _with_table(lines, table.filter("not _whole").drop("uri", "_whole"), ordered=True)
    found = joined.select("doc_id", "_block", *state, "text").mapInArrow(_paths_of, "doc_id long, ordinal int, value string, path_type string, line int, column int, context string")
    if apart:
        found = found.unionByName(extract_tree(scan_files(spark, apart), "csv"))
    return found
