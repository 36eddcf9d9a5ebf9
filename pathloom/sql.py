"""The operators as Spark SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import udtf

from .functions import classify, errors, formats, paths, predicates
from .operators.trees import found_in, path_type
from .sources.documents import language_of_file

_ROW = "ordinal int, value string, path_type string, line int, column int, context string"


def _table_function(kind: str):
    class Paths:
        def eval(self, content: str):
            for n, (value, line, column, context) in enumerate(found_in(kind, content)[0]):
                yield n, value, path_type(value), line, column, context

    return udtf(Paths, returnType=_ROW)


#: SQL functions of one argument ``p`` and its type; their bodies are these native expressions.
SCALARS: dict[str, tuple[str, Callable[[str], Column]]] = {
    "path_normalize": ("STRING", paths.normalize), "path_components": ("STRING", paths.components), "path_extension": ("STRING", paths.extension),
    "path_directory": ("STRING", paths.directory), "path_file_name": ("STRING", paths.file_name), "path_base_name": ("STRING", paths.base_name),
    "path_pattern": ("STRING", paths.pattern), "path_naming": ("STRING", paths.naming), "path_type": ("STRING", classify.detect),
    "path_type_generic": ("STRING", classify.generic), "path_type_module": ("STRING", classify.module), "path_type_style": ("STRING", classify.style),
    "path_type_markup": ("STRING", classify.markup), "path_like_strict": ("STRING", predicates.is_path_strict), "path_like_spaced": ("STRING", predicates.is_path_spaced),
    "path_like_json": ("STRING", predicates.is_path_json), "path_is_module": ("STRING", predicates.is_module_path), "path_is_absolute": ("STRING", predicates.is_absolute_path),
    "path_is_relative": ("STRING", predicates.is_relative_path), "path_is_file": ("STRING", predicates.is_file_path), "path_is_directory": ("STRING", predicates.is_directory_path),
    "path_is_safe": ("STRING", predicates.is_path_safe), "path_message": ("STRING", paths.invalid_file_path), "path_label": ("STRING", formats.path),
    "path_language": ("STRING", language_of_file), "error_category": ("STRING", errors.categorize), "error_masked": ("STRING", paths.sanitize_message),
    "format_bytes": ("BIGINT", formats.number_of_bytes), "format_duration": ("BIGINT", formats.duration), "format_percentage": ("DOUBLE", formats.percentage),
}


def _body(spark: SparkSession, kind: str, expression: Column) -> tuple[str, str]:
    """(type, SQL text) of an expression over the column ``p``."""
    one = spark.sql(f"SELECT CAST(NULL AS {kind}) AS p").select(expression.alias("x"))
    analysed = one._jdf.queryExecution().analyzed().projectList().head().child()
    return one.schema["x"].dataType.simpleString(), analysed.sql()


def register(spark: SparkSession) -> None:
    """Table functions extract_csv, extract_json, extract_toml and collect_paths, and the scalar functions of ``SCALARS`` and path_depth.

    The scalar ones are SQL functions whose bodies are the native expressions, so the
    optimiser sees through them. The table functions call Python for each document: for
    many documents use ``operators.trees.extract_tree``.
    """
    for kind, name in (("csv", "extract_csv"), ("json", "extract_json"), ("toml", "extract_toml"), ("tree", "collect_paths")):
        spark.udtf.register(name, _table_function(kind))
    for name, (kind, function) in SCALARS.items():
        returns, body = _body(spark, kind, function("p"))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(p {kind}) RETURNS {returns} RETURN {body}")
    slash = "regexp_replace(replace(p, '\\\\', '/'), '/+', '/')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION path_depth(p STRING) RETURNS INT RETURN size(filter(split({slash}, '/', -1), s -> s <> ''))")
