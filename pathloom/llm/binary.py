"""Token ids as length-delimited binary records, with an offset index beside them.

Fixed values of the file format: a file is a sequence of frames, one a document:

    8 bytes   length of the payload, little-endian unsigned
    4 bytes   masked CRC-32 of those 8 bytes
    payload   8 bytes doc_id (signed), 1 byte flags, then the ids, little-endian unsigned
    4 bytes   masked CRC-32 of the payload
    1 byte    0x0A

Flags: bit 0, ids have 4 bytes and not 2; bit 1, doc_id is null. A masked
checksum is the checksum rotated right by 15 bits plus 0xA282EAD8, so that a
checksum stored inside data that is itself checksummed does no harm.

Frames are written through Spark's own file writer, so files go to any store
Spark knows and only committed tasks count; the closing byte is the writer's
record end. The index has a row for each frame: file, byte offset and length,
doc_id, number of ids, and the number of ids of all documents before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, release
from .tokens import read_vocabulary, tokenizer

_HEAD, _CRC, _DOC = Struct("<QI"), Struct("<I"), Struct("<qB")
END = b"\n"
_FRAMES = "file string, position long, bytes long, doc_id long, n_tokens long"
_FLUSH = 8_000_000
#: Bytes of text that go to a file, about; files up to which their table (about 60 bytes a row) is broadcast.
FILE_BYTES, _BROADCAST_FILES = 48_000_000, 200_000


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    """A document's frame without its closing byte."""
    flags = int(wide) | (2 if doc_id is None else 0)
    payload = _DOC.pack(doc_id or 0, flags) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = len(payload).to_bytes(8, "little")
    return b"".join([length, _CRC.pack(masked_crc(length)), payload, _CRC.pack(masked_crc(payload))])


def unframe(data: memoryview, at: int, check: bool = True) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and end of the frame that starts at ``at``; raises ValueError if it is damaged."""
    if at + 12 > len(data):
        raise ValueError(f"no whole frame at byte {at}")
    length, crc = _HEAD.unpack_from(data, at)
    end = at + 12 + length
    if masked_crc(bytes(data[at : at + 8])) != crc or end + 5 > len(data) or data[end + 4] != END[0]:
        raise ValueError(f"damaged frame head at byte {at}")
    payload = data[at + 12 : end]
    if check and masked_crc(payload) != _CRC.unpack_from(data, end)[0]:
        raise ValueError(f"damaged payload at byte {at}")
    doc_id, flags = _DOC.unpack_from(payload)
    ids = np.frombuffer(payload[_DOC.size :], dtype="<u4" if flags & 1 else "<u2")
    return (None if flags & 2 else doc_id), ids, end + 5


def frames_in(data: bytes, check: bool = True) -> Iterator[tuple[int, int | None, np.ndarray, int]]:
    """(offset, doc_id, ids, frame length) of every frame of a file."""
    view, at = memoryview(data), 0
    while at < len(view):
        doc_id, ids, end = unframe(view, at, check)
        yield at, doc_id, ids, end - at
        at = end


def write(docs: DataFrame, path: str, vocabulary_path: str, *, end_id: int | None = 1, files: int | None = None) -> None:
    """Tokenise all documents and write path/data in ascending doc_id order, then path/index.

    Nulls: a null doc_id comes first, a null text is its end id alone. Rows that
    repeat a doc_id keep a frame each, in order of a hash of their texts, and may lie in
    several files. ``files`` defaults to what gives each about ``FILE_BYTES`` of text; only
    a document that is longer itself makes a longer file. An empty table gives empty
    folders. Columns besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_draw"))
    if files is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        files = max(1, min(4 * spark.sparkContext.defaultParallelism, -(-size // 1_000_000)), -(-size // FILE_BYTES))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary.value, end_id)
        wide = max(words.size, end_id or 0) > 65_536
        out, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                out.append(frame(doc_id.as_py(), np.frombuffer(words.encode(text.as_py()), dtype="<u4"), wide))
                held += len(out[-1])
                if held > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    order = (F.col("doc_id").asc_nulls_first(), "_draw")
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
    raw = map_batches(ordered, frames, "value binary", keeps=True).select(F.col("value").cast("string"))
    raw.write.option("lineSep", END.decode()).option("compression", "none").text(f"{path}/data")
    frames_found = materialize(_scan(spark, path), "binary-frames")
    whole = frames_found.groupBy("file").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy(file_number("file")).rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    whole.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/files")
    inside = Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = frames_found.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    bases = file_table(spark, path).select("file", "before")
    placed.join(bases, "file").select(
        "file", "position", "bytes", "doc_id", "n_tokens", (F.col("before") + F.col("_inside")).alias("start")
    ).write.parquet(f"{path}/index")
    release(frames_found)


def file_number(file: str) -> Column:
    """The place of a data file in the order of the documents; names have leading zeros up to five digits only."""
    return F.regexp_extract(file, "part-([0-9]+)", 1).cast("long")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The data files, whole: (file, content)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return found.filter("length > 0").select(F.substring_index("path", "/", -1).alias("file"), "content")


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """The frames of all files as their heads and payload sizes tell."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [(at, size, doc_id, len(ids)) for at, doc_id, ids, size in frames_in(content.as_buffer(), check=False)]
                at, size, doc, n = zip(*rows, strict=True)
                columns = [[file.as_py()] * len(rows), at, size, doc, n]
                types = [pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "position", "bytes", "doc_id", "n_tokens"]
                )

    return map_batches(_files(spark, path), scan, _FRAMES)


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """One row a data file: (file, n_docs, n_tokens, before), the last the ids of all files before it."""
    return spark.read.schema("file string, n_docs long, n_tokens long, before long").parquet(f"{path}/files")


def index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index: (file, position, bytes, doc_id, n_tokens, start)."""
    return spark.read.schema(_FRAMES + ", start long").parquet(f"{path}/index")


def read(spark: SparkSession, path: str, chosen: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ids as little-endian unsigned 32-bit integers.

    Without ``chosen`` all frames are read in file order. ``chosen``: rows of the
    index, for shuffled reads: each of their files is read once and jumped through
    by the offsets. Every frame's checksums are verified.
    """
    if chosen is None:
        bases = file_table(spark, path).select("file", "before")
        if bases.count() <= _BROADCAST_FILES:
            bases = F.broadcast(bases)
        none = F.lit(None).cast("array<long>")
        pairs = _files(spark, path).join(bases, "file").select("content", "before", none.alias("at"), none.alias("start"))
    else:
        wanted = chosen.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("position", "start"))).alias("_at"))
        pairs = _files(spark, path).join(wanted, "file").select(
            "content", F.lit(0).cast("long").alias("before"), F.expr("transform(_at, x -> x.position)").alias("at"), F.expr("transform(_at, x -> x.start)").alias("start")
        )

    def found(view: memoryview, before: int, at: list | None, start: list | None) -> Iterator[tuple]:
        if at is None:
            place = 0
            while place < len(view):
                doc_id, ids, place = unframe(view, place)
                yield doc_id, before, ids
                before += len(ids)
        else:
            for a, s in zip(at, start, strict=True):
                doc_id, ids, _ = unframe(view, a)
                yield doc_id, s, ids

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ, strict=True)], schema=_READ)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, before, at, start in zip(*(batch.column(i) for i in range(4)), strict=True):
                out, held = [], 0
                for doc_id, s, ids in found(memoryview(content.as_buffer()), before.as_py(), at.as_py(), start.as_py()):
                    out.append((doc_id, s, len(ids), ids.astype("<u4").tobytes()))
                    held += 4 * len(ids)
                    if held > _FLUSH:
                        yield batch_of(out)
                        out, held = [], 0
                yield batch_of(out)

    return map_batches(pairs, pick, "doc_id long, start long, n_tokens long, ids binary")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
