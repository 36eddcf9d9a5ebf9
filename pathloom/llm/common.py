"""Helpers shared by the corpus operators: shared storage, hashing, schemas."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the characters that separate words everywhere here.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one if unset (local mode only)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_dirs:
        _own_dirs[key] = "file://" + tempfile.mkdtemp(prefix="pathloom-")
    return _own_dirs[key]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Lineage ends at the written files, so a lost executor never repeats the
    work above them.
    """
    path = fresh_path(df.sparkSession, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.pathloom_path = path
    give_back()
    return back


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that no returned result reads."""
    for table in tables:
        if path := getattr(table, "pathloom_path", None):
            remove_path(table.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def crc_mod(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the split between learning and held-out rows."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def give_back() -> None:
    """Return freed memory to the system; Python workers are reused from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


_kept: dict[object, object] = {}


def keep_here(key: object, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept in this worker process from task to task; one thing at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 16_000_000


def map_batches(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *, keeps: bool = False
) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes; a task's memory goes back when it ends.

    ``keeps``: whether its tasks use ``keep_here``; those of others let go of what is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:  # a user's own value stays
        df.sparkSession.conf.set(key, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps and _kept:
            _kept.clear()
            give_back()
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Apply a batch function to the columns of ``df`` as Python lists.

    ``make`` runs once in each task and returns the batch function, so that
    models and caches are set up once per task.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                for piece in _small(batch):
                    columns = {name: piece.column(i).to_pylist() for i, name in enumerate(piece.schema.names)}
                    yield pa.RecordBatch.from_pydict(work(columns), schema=arrow)

    return map_batches(df, run, schema)


def _small(batch: pa.RecordBatch, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about ``limit`` bytes, so that lists of long texts stay small."""
    step = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(1, batch.nbytes))))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


# ---------------------------------------------------------------- word hashes

_SPACE_TABLE = np.zeros(256, dtype=bool)
_SPACE_TABLE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of the longest word whose hash comes from a table.
_TABLED = 64


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of arrays of 64-bit values (splitmix64)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of the words of a text, all at once, equal in every process.

    Tabulation hashing: every byte at every place of a word has a number of its own, as if
    drawn at random, and their sum is mixed with the word's length. So two words share a
    hash by chance alone, whatever they are made of. The hash of a word of more than 64
    bytes is taken from its BLAKE2b digest.
    """

    def __init__(self) -> None:
        self.table = mix64(np.arange(1, 256 * _TABLED + 1, dtype=np.uint64), 7)

    def __call__(self, data: bytes) -> np.ndarray:
        """Hashes of the white-space separated words of UTF-8 ``data``, in order."""
        return self._hashes(data, *word_spans(data))

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the words of all texts, where each text's begin and the last's end)."""
        data = b" ".join(texts)
        raw, starts, sizes = word_spans(data)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return self._hashes(data, raw, starts, sizes), np.searchsorted(starts, begin)

    def _hashes(self, data: bytes, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, dtype=np.uint64)
        inside = np.flatnonzero(~_SPACE_TABLE[raw])
        place = inside - np.repeat(starts, sizes)
        longest = sizes.max()
        if longest > _TABLED:
            np.minimum(place, _TABLED - 1, out=place)
        total = np.add.reduceat(self.table[(place << 8) | raw[inside]], np.cumsum(sizes) - sizes)
        out = mix64(total + sizes.astype(np.uint64))
        if longest > _TABLED:
            for i in np.flatnonzero(sizes > _TABLED).tolist():
                out[i] = int.from_bytes(blake2b(data[starts[i] : starts[i] + sizes[i]], digest_size=8).digest(), "little")
        return out


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a text as numbers, where its white-space separated words start, and their bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE_TABLE[raw]
    edge = np.diff(inside)
    starts = np.flatnonzero(edge == 1)
    return raw, starts, np.flatnonzero(edge == -1) - starts


def _chained(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(words) - size + 1
    value = np.full(n, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        value = mix64(value, 11) + words[j : n + j]
    return mix64(value, 13)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence."""
    return distinct(_chained(words, min(len(words), k))) if len(words) else words


def shingle_sets(words: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """``shingles`` of many texts, whose words lie between neighbouring bounds."""
    every = _chained(words, k) if len(words) >= k else words
    spans = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
    return [distinct(every[a : z - k + 1]) if z - a >= k else shingles(words[a:z], k) for a, z in spans]
