"""Scalar path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import is_absolute_path
from .text import column


def normalize(c: Column | str) -> Column:
    """Forward slashes, no repeated ones, none at the end except for the root."""
    c = F.regexp_replace(F.replace(column(c), F.lit("\\"), F.lit("/")), "/+", "/")
    return F.when((F.length(c) > 1) & c.endswith("/"), F.regexp_replace(c, "/\\z", "")).otherwise(c)


def components(c: Column | str) -> Column:
    """struct(directory, filename, extension, basename) of the normalised path; a leading dot starts an extension."""
    return F.struct(directory(c).alias("directory"), file_name(c).alias("filename"), written_extension(c).alias("extension"), base_name(c).alias("basename"))


def directory(c: Column | str) -> Column:
    n = normalize(c)
    return F.when(n.contains("/"), F.regexp_replace(n, "/[^/]*\\z", "")).otherwise("")


def file_name(c: Column | str) -> Column:
    return F.regexp_extract(normalize(c), "([^/]*)\\z", 1)


def written_extension(c: Column | str) -> Column:
    """What follows the file name's last dot, in its own case."""
    name = file_name(c)
    return F.when(name.contains("."), F.regexp_extract(name, "\\.([^.]*)\\z", 1)).otherwise("")


def base_name(c: Column | str) -> Column:
    name = file_name(c)
    return F.when(name.contains("."), F.regexp_replace(name, "\\.[^.]*\\z", "")).otherwise(name)


def depth(c: Column | str) -> Column:
    """Number of non-empty segments."""
    return F.size(F.filter(F.split(normalize(c), "/", -1), lambda s: s != ""))


def extension(c: Column | str) -> Column:
    return F.lower(written_extension(c))


def resolve(base: Column | str, relative: Column | str) -> Column:
    """``relative`` seen from the folder of ``base``; parent steps are not collapsed."""
    relative = column(relative)
    joined = F.concat(directory(base), F.lit("/"), relative)
    return normalize(F.when(is_absolute_path(relative), relative).otherwise(joined))


def pattern(c: Column | str) -> Column:
    """Letters and digits as X."""
    return F.regexp_replace(column(c), "[a-zA-Z0-9]", "X")


def naming(c: Column | str) -> Column:
    """The naming convention of a base name."""
    c = column(c)
    return (
        F.when(c.contains("_"), "snake_case").when(c.contains("-"), "kebab-case")
        .when(c.rlike("[A-Z]") & c.rlike("[a-z]"), "camelCase")
        .when(c == F.upper(c), "UPPERCASE").when(c == F.lower(c), "lowercase").otherwise("mixed")
    )


def posix_resolve(folder: Column | str, relative: Column | str) -> Column:
    """An absolute path: ``relative`` from ``folder``, with ``.`` and ``..`` worked out."""
    relative, folder = column(relative), column(folder)
    whole = F.when(relative.startswith("/"), relative).otherwise(F.concat(folder, F.lit("/"), relative))
    parts = F.filter(F.split(whole, "/", -1), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda out, s: F.when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def sanitize_message(c: Column | str) -> Column:
    """An error message without user names and secrets."""
    from .text import NOT_SPACE, SPACE

    c = column(c)
    #: What is masked, in this order.
    for find, put in (
        ("/Users/[^/]+/", "/Users/***/"), ("/home/[^/]+/", "/home/***/"), (r"C:\\Users\\[^\\]+\\", r"C:\\Users\\***\\"),
        (f"(?i)password[=:]{SPACE}*{NOT_SPACE}+", "password=***"), (f"(?i)token[=:]{SPACE}*{NOT_SPACE}+", "token=***"),
        (f"(?i)key[=:]{SPACE}*{NOT_SPACE}+", "key=***"),
    ):
        c = F.regexp_replace(c, find, put)
    return c


def invalid_file_path(c: Column | str) -> Column:
    """The message about a typed path that cannot be one, or null."""
    from .predicates import INVALID, RESERVED_PATTERN
    from .text import trim

    c = column(c)
    return (
        F.when(c.isNull() | (F.length(trim(c)) == 0), "Path cannot be empty")
        .when(c.rlike(f"[{INVALID}]"), "Path contains invalid characters").when(c.rlike(RESERVED_PATTERN), "Path uses a reserved name")
    )
