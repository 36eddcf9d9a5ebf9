"""The whole extraction: documents of any language to paths and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import column
from ..operators.admission import admit
from ..operators.extract import NATIVE
from ..operators.post import first_in_array, numbered
from ..operators.resolve import canonical
from ..operators.settings import EngineConfig
from ..operators.trees import bounded, tree_result
from ..schema import PATH_ARRAY

#: The format of each language id.
LANGUAGES = {
    "csv": "csv", "toml": "toml", "dotenv": "dotenv", "env": "dotenv", "javascript": "javascript", "javascriptreact": "javascript",
    "typescript": "typescript", "typescriptreact": "typescript", "json": "json", "jsonc": "json", "html": "html", "css": "css",
    "scss": "css", "less": "css",
}
SUPPORTED = ("csv", "toml", "dotenv", "javascript", "typescript", "json", "html", "css")
PARSED = ("csv", "json", "toml")


def file_format(language_id: Column | str) -> Column:
    """The format of a language id, or ``unknown``."""
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column(language_id)), F.lit("unknown"))


def unsupported_error(language_id: Column | str) -> Column:
    #: The texts of the error.
    language = F.coalesce(column(language_id), F.lit(""))
    return F.struct(
        F.lit("format").alias("category"), F.lit("info").alias("severity"),
        F.concat(
            F.lit("Path extraction is not supported for "), language,
            F.lit(" files. Supported formats: CSV, TOML, ENV, JS, TS, JSON, HTML, CSS."),
        ).alias("message"),
        F.concat(F.lit("File type: "), language).alias("context"), F.lit(False).alias("recoverable"), F.lit("none").alias("recovery_action"),
        F.create_map(F.lit("languageId"), language, F.lit("supportedFormats"), F.lit(",".join(SUPPORTED))).alias("metadata"),
    )


@dataclass(frozen=True)
class Extraction:
    """Projections of ``documents``, which reads its input once and shuffles nothing.

    documents: a row a document, (doc_id, success, paths, error); paths: one row a path;
    errors: one row a failed document; results: one row a document, with counts.
    """

    documents: DataFrame
    dedupe: bool = False
    keep: tuple[str, ...] = ()

    @property
    def paths(self) -> DataFrame:
        return self.placed.drop(*self.keep)

    @property
    def placed(self) -> DataFrame:
        """``paths`` with the columns that were kept of their documents. Duplicates go inside their document's array."""
        every = first_in_array("paths") if self.dedupe else numbered("paths")
        rows = self.documents.select("doc_id", *self.keep, F.explode_outer(every).alias("_each")).filter(F.col("_each").isNotNull())
        return rows.select("doc_id", *self.keep, "_each.ordinal", "_each.path.*")

    @property
    def errors(self) -> DataFrame:
        return self.documents.filter(F.col("error").isNotNull()).select("doc_id", "error.*")

    @property
    def results(self) -> DataFrame:
        values = F.transform("paths", lambda p: p["value"])
        return self.documents.select("doc_id", "success", F.size(F.array_distinct(values) if self.dedupe else values).cast("long").alias("n_paths"))


def native_paths(language_id: Column | str, content: Column | str) -> Column:
    """Paths of a document in one expression, by its language; empty for formats that need a parser."""
    kind = _extractor(language_id)
    out = None
    for name, paths in NATIVE.items():
        out = F.when(kind == name, paths(content)) if out is None else out.when(kind == name, paths(content))
    return out.otherwise(F.array().cast(PATH_ARRAY))


def _extractor(language_id: Column | str) -> Column:
    kind = file_format(language_id)
    return F.when(kind == "typescript", "javascript").otherwise(kind)


def _parse_error(message: Column) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit("parsing").alias("category"), F.lit("error").alias("severity"), message.alias("message"), none.cast("string").alias("context"),
        F.lit(True).alias("recoverable"), F.lit("skip").alias("recovery_action"), none.cast("map<string,string>").alias("metadata"),
    )


def extract_documents(docs: DataFrame, *, report_parse_errors: bool = False, dedupe: bool = False, keep: tuple[str, ...] = ()) -> Extraction:
    """Extract from (doc_id, language_id, content) in one pass.

    Native formats are expressions; the texts of the others, and only those, go through
    one Arrow function. ``errors`` has the unsupported documents, and the unparsable
    ones if ``report_parse_errors``; without it those succeed with no paths. With
    ``dedupe`` a document's paths keep the first of equal values. ``keep``: columns of
    ``docs`` that come along (see ``Extraction.placed``).
    """
    kind = _extractor("language_id")
    parsed = kind.isin(*PARSED)
    rows = bounded(docs).select(
        "doc_id", *(f"`{c}`" for c in keep), "language_id", tree_result(kind, F.when(parsed, F.col("content"))).alias("_tree"),
        F.when(~parsed, F.col("content")).alias("_native"), parsed.alias("_parsed"),
    )
    failed = F.when(F.lit(report_parse_errors) & F.col("_parsed") & F.col("_tree.message").isNotNull(), _parse_error(F.col("_tree.message")))
    error = F.when(file_format("language_id") == "unknown", unsupported_error("language_id")).otherwise(failed)
    paths = F.when(F.col("_parsed"), F.col("_tree.paths")).otherwise(native_paths("language_id", "_native"))
    kept = ["doc_id", *(f"`{c}`" for c in keep)]
    out = rows.select(*kept, paths.alias("paths"), error.alias("error"))
    return Extraction(out.select(*kept, F.col("error").isNull().alias("success"), "paths", "error"), dedupe, keep)


def extract_with(
    docs: DataFrame, config: EngineConfig, *, folders: DataFrame | None = None, links: DataFrame | None = None, sources: str | None = None,
    parents: bool = False,
) -> tuple[Extraction, DataFrame]:
    """(extraction, resolved paths) of documents as a configuration asks for.

    With ``safety_enabled`` documents above the size limit are not read. Parse errors
    and duplicates follow ``show_parse_errors`` and ``dedupe_enabled``. Paths are
    resolved if ``folders`` or ``links`` are given (see ``resolve.canonical``), else
    ``resolved`` is the path as it stands. ``sources``: a column of ``docs`` with the
    place of each document, by which its workspace folder is found; it travels with the
    paths. ``parents``: links on folders and links of links are followed too.
    """
    admitted = admit(docs, max_units=config.safety_file_size_warn_bytes, max_lines=config.safety_large_output_lines_threshold) if config.safety_enabled else docs
    keep = (sources,) if sources else ()
    found = extract_documents(admitted, report_parse_errors=config.show_parse_errors, dedupe=config.dedupe_enabled, keep=keep)
    if folders is None and links is None:
        return found, found.paths.withColumn("resolved", F.col("value"))
    rows = found.placed.withColumnRenamed(sources, "_source") if sources else found.paths
    resolved = canonical(rows, folders=folders, links=links, at="_source" if sources else "value", parents=parents)
    return found, resolved.drop("_source")
