"""Extraction from streams: extractors need no state, so they run unchanged; profiles of sources are state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.engine import Extraction, extract_documents
from ..sources.documents import language_of_file


def stream_files(spark: SparkSession, path: str, *, glob: str | None = None, max_files: int = 1000) -> DataFrame:
    """New files of a folder as a stream of documents."""
    reader = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", max_files).schema("value string")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).format("text").load(path)
    uri = F.col("_metadata.file_path")
    return files.select(F.xxhash64(uri).alias("doc_id"), uri.alias("uri"), language_of_file(uri).alias("language_id"), F.col("value").alias("content"))


def stream_documents(docs: DataFrame, *, report_parse_errors: bool = True, dedupe: bool = False, keep: tuple[str, ...] = ()) -> Extraction:
    """The whole extraction of a document stream, all formats and errors: projections of one streamed row a document."""
    return extract_documents(docs, report_parse_errors=report_parse_errors, dedupe=dedupe, keep=keep)


def stream_paths(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Path rows of a document stream, of all formats: (*keep, ordinal, value, path_type, line, column, context)."""
    found = stream_documents(docs, keep=tuple(c for c in keep if c != "doc_id")).placed
    return found.select(*(f"`{c}`" for c in keep), "ordinal", "value", "path_type", "line", "column", "context")


_PROFILE = "source string, documents long, paths long, failed long, types array<string>, counts array<long>"


class _Profiles(StatefulProcessor):
    """Counts of one source's documents, paths by type, and failures, since the stream began."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "documents long, paths long, failed long")
        self.types = handle.getMapState("types", "path_type string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        documents, paths, failed = self.totals.get() if self.totals.exists() else (0, 0, 0)
        new: dict[str, int] = {}
        for row in rows:
            documents, failed = documents + row["documents"], failed + row["failed"]
            for kind, n in zip(row["types"], row["counts"], strict=True):
                new[kind] = new.get(kind, 0) + n
        paths += sum(new.values())
        self.totals.update((documents, paths, failed))
        for kind, n in new.items():
            self.types.updateValue((kind,), (n + (self.types.getValue((kind,))[0] if self.types.containsKey((kind,)) else 0),))
        every = sorted((k[0], v[0]) for k, v in self.types.iterator())
        yield Row(source=key[0], documents=documents, paths=paths, failed=failed, types=[k for k, _ in every], counts=[n for _, n in every])

    def close(self) -> None:
        pass


def running_profiles(docs: DataFrame, source: str = "source", *, report_parse_errors: bool = True) -> DataFrame:
    """(source, documents, paths, failed, by_type) of a document stream: a row for each source that a batch adds to.

    Counts run since the stream began; state is a few numbers a source, kept in Spark's RocksDB store
    and restored with the stream's checkpoint. Documents become counts before they meet
    their source, a row each with at most as many numbers as there are types. A null source is one of its own, named "".
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = stream_documents(docs, report_parse_errors=report_parse_errors, keep=(source,)).documents
    kinds = F.transform("paths", lambda p: p["path_type"])
    counted = found.select(
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.lit(1).cast("long").alias("documents"), (~F.col("success")).cast("long").alias("failed"),
        F.array_distinct(kinds).alias("types"), F.transform(F.array_distinct(kinds), lambda k: F.size(F.filter(kinds, lambda x: x == k)).cast("long")).alias("counts"),
    )
    kept = counted.groupBy("source").transformWithState(_Profiles(), _PROFILE, "Update", "None")
    return kept.select("source", "documents", "paths", "failed", F.map_from_arrays("types", "counts").alias("by_type"))


def stream_distinct(paths: DataFrame, time: str, delay: str = "1 hour", by: tuple[str, ...] = ("doc_id", "value")) -> DataFrame:
    """The first of equal values that arrive within ``delay`` of each other; state is bounded by the watermark."""
    return paths.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(by))
