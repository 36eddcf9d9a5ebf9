"""The type of a path: file, relative, absolute, url or unknown, by format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import is_absolute_path
from .text import column, starts, trim


def _chain(*rules: tuple[Column, str]) -> Column:
    test, name = rules[0]
    out = F.when(test, name)
    for test, name in rules[1:]:
        out = out.when(test, name)
    return out.otherwise("unknown")


def _tail(c: Column) -> list[tuple[Column, str]]:
    return [(starts(c, "./", "../"), "relative"), (c.contains("."), "file")]


def generic(c: Column | str) -> Column:
    """CSV, dotenv, JSON, TOML and generic trees: drives need a backslash."""
    c = column(c)
    return _chain((starts(c, "http://", "https://", "file://"), "url"), (c.startswith("/"), "absolute"), (c.rlike(r"\A[A-Za-z]:\\"), "absolute"), *_tail(c))


def module(c: Column | str) -> Column:
    """JavaScript and TypeScript: drives with either slash."""
    c = column(c)
    return _chain((starts(c, "http://", "https://", "file://"), "url"), (c.startswith("/"), "absolute"), (c.rlike(r"\A[A-Za-z]:[/\\]"), "absolute"), *_tail(c))


def style(c: Column | str) -> Column:
    """Style sheets: protocol-relative addresses are urls; no drives."""
    c = column(c)
    return _chain((starts(c, "http://", "https://", "//"), "url"), (c.startswith("/"), "absolute"), *_tail(c))


def markup(c: Column | str) -> Column:
    """HTML: as style sheets, and fragments are unknown."""
    c = column(c)
    relative, file = _tail(c)
    return _chain((starts(c, "http://", "https://", "//"), "url"), (c.startswith("/"), "absolute"), relative, (c.startswith("#"), "unknown"), file)


def detect(c: Column | str) -> Column:
    """Of any string: a separator makes it relative, a dot before its end a file."""
    c = trim(c)
    return _chain(
        (starts(c, "http://", "https://", "ftp://"), "url"), (is_absolute_path(c), "absolute"), (c.rlike(r"\A\.\.?/|[/\\]"), "relative"),
        (c.contains(".") & ~c.endswith("."), "file"),
    )
