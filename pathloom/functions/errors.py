"""Categories, severities and recovery of errors, from their messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column

#: Keywords in order of testing, and kinds of error by category.
KEYWORDS = (
    (("parse", "syntax"), "parsing"), (("validation", "invalid"), "validation"), (("permission", "access"), "file-system"),
    (("config", "setting"), "configuration"), (("safety", "threshold"), "safety"),
)
KINDS = ("parse", "validation", "safety", "file-system", "configuration", "operational")
RETRIES = {"file-system": (3, 1000), "operational": (2, 2000)}


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words))


def categorize(message: Column | str) -> Column:
    low = F.lower(column(message))
    (words, name), *rest = KEYWORDS
    out = F.when(_any(low, words), name)
    for words, name in rest:
        out = out.when(_any(low, words), name)
    return out.otherwise("operational")


def severity(message: Column | str, category: Column | str) -> Column:
    low, category = F.lower(column(message)), column(category)
    return (
        F.when(_any(low, ("critical", "fatal")), "critical").when(low.contains("error") | (category == "file-system"), "error")
        .when(low.contains("warning") | (category == "validation"), "warning").otherwise("info")
    )


def recovery_action(category: Column | str, severity_: Column | str) -> Column:
    category, severity_ = column(category), column(severity_)
    return (
        F.when((category == "file-system") & (severity_ == "error"), "retry").when(category.isin("parsing", "validation"), "skip")
        .when(severity_ == "critical", "abort").otherwise("fallback")
    )


def is_recoverable(message: Column | str, category: Column | str) -> Column:
    message, category = column(message), column(category)
    return (
        F.when(category.isin("parse", "configuration", "validation"), True)
        .when(category == "file-system", _any(message, ("permission", "network")))
        .when(category == "operational", ~message.contains("fatal")).otherwise(False)
    )


def error_type(category: Column | str) -> Column:
    category = column(category)
    return F.when(category.isin(*KINDS), F.concat(F.lit("path-"), category, F.lit("-error"))).otherwise("unknown-error")


def recovery_options(category: Column | str) -> Column:
    """struct(retryable, max_retries, retry_delay_ms, has_fallback)."""
    category = column(category)
    pick = lambda i: F.coalesce(*[F.when(category == k, v[i]) for k, v in RETRIES.items()], F.lit(0))
    return F.struct(
        category.isin(*RETRIES).alias("retryable"), pick(0).alias("max_retries"), pick(1).alias("retry_delay_ms"),
        (category == "configuration").alias("has_fallback"),
    )


def error(message: Column, *, category: Column | None = None, context: Column | None = None, path: Column | None = None) -> Column:
    """An error struct: everything that follows from the message is worked out."""
    category = categorize(message) if category is None else category
    level = severity(message, category)
    return F.struct(
        category.alias("category"), level.alias("severity"), message.alias("message"), (F.lit(None).cast("string") if context is None else context).alias("context"),
        (level != "critical").alias("recoverable"), recovery_action(category, level).alias("recovery_action"),
        (F.lit(None).cast("string") if path is None else path).alias("filepath"),
    )


#: What a user reads about an error of a category; {0} is the message (of ``parse``, the file).
MESSAGES = {
    "parse": "Failed to parse path values: {0}", "file-system": "File system error: {0}", "configuration": "Configuration error: {0}",
    "validation": "Path validation failed: {0}", "safety": "Safety threshold exceeded: {0}",
    "operational": "Path extraction failed: {0}", "": "Unknown error: {0}",
}
SUGGESTIONS = {
    "parse": "Check the path format and ensure values are valid",
    "file-system": "Check file permissions and ensure the file exists",
    "configuration": "Reset to default settings or check configuration syntax",
    "validation": "Review path values and ensure they meet validation criteria",
    "safety": "Reduce file size or adjust safety thresholds",
    "operational": "Try again or check system resources",
    "": "Check the logs for more details and consider reporting this issue",
}


def _lookup(category: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for k, v in table.items() if k for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), F.lit(table[""]))


def user_message(message: Column | str, category: Column | str, file: Column | None = None) -> Column:
    message, category = column(message), column(category)
    subject = F.when(category == "parse", F.coalesce(F.lit(None).cast("string") if file is None else file, F.lit("unknown file"))).otherwise(message)
    return F.replace(_lookup(category, MESSAGES), F.lit("{0}"), subject)


def suggestion(category: Column | str) -> Column:
    return _lookup(column(category), SUGGESTIONS)


def enhanced_error(
    message: Column | str, category: Column | str, file: Column | None = None, *, recoverable: Column | None = None, severity: Column | None = None,
    suggestion_: Column | None = None, at: Column | None = None,
) -> Column:
    """An error with what a user needs: struct(category, type, message, user_message, suggestion, recoverable, severity, timestamp).

    What is given wins; the rest follows from category and message. ``at``: when it happened, null if not told, so that results repeat.
    """
    message, category = column(message), column(category)
    return F.struct(
        category.alias("category"), error_type(category).alias("type"), message.alias("message"), user_message(message, category, file).alias("user_message"),
        F.coalesce(F.lit(None).cast("string") if suggestion_ is None else suggestion_, suggestion(category)).alias("suggestion"),
        F.coalesce(F.lit(None).cast("boolean") if recoverable is None else recoverable, is_recoverable(message, category)).alias("recoverable"),
        F.coalesce(F.lit(None).cast("string") if severity is None else severity, F.lit("medium")).alias("severity"),
        (F.lit(None).cast("timestamp") if at is None else at).alias("timestamp"),
    )


def parse_error(message: Column, path: Column | None = None, line: Column | None = None, at: Column | None = None) -> Column:
    """A recoverable parsing error with its place, if known."""
    none = F.lit(None)
    return F.struct(
        F.lit("parsing").alias("category"), F.lit("warning").alias("severity"), message.alias("message"),
        (none.cast("string") if path is None else path).alias("filepath"), (none.cast("int") if line is None else line).alias("line"),
        (none.cast("int") if at is None else at).alias("column"), F.lit(True).alias("recoverable"), F.lit("skip").alias("recovery_action"),
    )


def safety_warning(message: Column) -> Column:
    """A recoverable safety error of medium severity, with what a user reads about it."""
    category = F.lit("safety")
    return F.struct(
        category.alias("category"), F.lit("medium").alias("severity"), message.alias("message"), user_message(message, category).alias("user_message"),
        suggestion(category).alias("suggestion"), F.lit(True).alias("recoverable"),
    )
