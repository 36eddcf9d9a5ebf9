"""Documents from files, and what their names and language ids say of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import column

#: The registry of file types: type, name, extensions, language ids, description.
FILE_TYPES = (
    ("json", "JSON", (".json",), ("json",), "JavaScript Object Notation files"),
    ("yaml", "YAML", (".yaml", ".yml"), ("yaml", "yml"), "YAML Ain't Markup Language files"),
    ("javascript", "JavaScript", (".js", ".mjs", ".cjs"), ("javascript",), "JavaScript source files"),
    ("typescript", "TypeScript", (".ts", ".tsx", ".mts", ".cts"), ("typescript", "typescriptreact"), "TypeScript source files"),
    ("log", "Log", (".log", ".txt"), ("log", "plaintext"), "Log and text files"),
    ("ini", "INI", (".ini", ".cfg", ".conf"), ("ini",), "Configuration files"),
    ("csv", "CSV", (".csv",), ("csv",), "Comma-separated values files"),
    ("toml", "TOML", (".toml",), ("toml",), "Tom's Obvious, Minimal Language files"),
    ("dotenv", "Environment", (".env", ".env.local", ".env.production"), ("dotenv", "env"), "Environment variable files"),
)
#: Language ids of file names, as editors assign them, for scans of files.
LANGUAGE_OF_EXTENSION = {
    ".csv": "csv", ".toml": "toml", ".env": "dotenv", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascriptreact",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "typescriptreact", ".json": "json", ".jsonc": "jsonc",
    ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".less": "less", ".yaml": "yaml", ".yml": "yaml", ".ini": "ini",
    ".log": "log", ".txt": "plaintext",
}


def file_types(spark: SparkSession) -> DataFrame:
    """The registry as a table."""
    rows = [(t, n, list(e), list(ids), d) for t, n, e, ids, d in FILE_TYPES]
    return spark.createDataFrame(rows, "type string, name string, extensions array<string>, language_ids array<string>, description string")


def supported(spark: SparkSession, what: str) -> DataFrame:
    """All supported types, extensions or language_ids, one a row."""
    table = file_types(spark)
    return table.select(F.col("type").alias(what)) if what == "types" else table.select(F.explode(what).alias(what))


def _lookup(c: Column, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), c)


def file_extension(name: Column | str) -> Column:
    """From the last dot, lower-case; empty without a dot or if the only dot leads the name."""
    return F.lower(F.regexp_extract(column(name), "(?s)\\A.+(\\.[^.]*)\\z", 1))


def type_of_extension(name: Column | str) -> Column:
    """The registered type of a file name's extension, or null."""
    return _lookup(file_extension(name), {e: t for t, _, es, _, _ in FILE_TYPES for e in es})


def type_of_language(language_id: Column | str) -> Column:
    """The registered type of a language id, or ``unknown``."""
    return F.coalesce(_lookup(column(language_id), {i: t for t, _, _, ids, _ in FILE_TYPES for i in ids}), F.lit("unknown"))


def is_supported_type(kind: Column | str) -> Column:
    return column(kind).isin(*(t for t, *_ in FILE_TYPES))


def language_of_file(path: Column | str) -> Column:
    """The language id of a file by its name; ``.env`` and ``.env.*`` are environment files."""
    name = F.substring_index(column(path), "/", -1)
    return F.when(name.rlike("\\A\\.env(?:\\..*)?\\z"), "dotenv").otherwise(F.coalesce(_lookup(file_extension(name), LANGUAGE_OF_EXTENSION), F.lit("unknown")))


def scan_files(spark: SparkSession, path: str | list[str], *, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Whole files as documents: (doc_id, uri, language_id, content). doc_id is a hash of the uri."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).text(path, wholetext=True)
    uri = F.col("_metadata.file_path")
    return files.select(F.xxhash64(uri).alias("doc_id"), uri.alias("uri"), language_of_file(uri).alias("language_id"), F.col("value").alias("content"))


def from_table(table: DataFrame, content: str, *, doc_id: str, language_id: str | Column, uri: str | None = None) -> DataFrame:
    """Documents from any table with a text column."""
    language = F.lit(language_id) if isinstance(language_id, str) and language_id not in table.columns else language_id
    return table.select(
        F.col(doc_id).alias("doc_id"), (F.col(uri) if uri else F.lit(None).cast("string")).alias("uri"),
        (F.col(language) if isinstance(language, str) else language).alias("language_id"), F.col(content).alias("content"),
    )


def csv_records(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """CSV files of known width as rows of cells, split by Spark's own reader."""
    schema = ", ".join(f"c{i} string" for i in range(columns))
    return spark.read.option("multiLine", True).option("header", False).option("mode", "PERMISSIVE").schema(schema).csv(path)
