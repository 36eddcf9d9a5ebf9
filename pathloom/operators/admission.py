"""Admission of documents before extraction, and warnings about heavy ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import REFUSED
from ..functions.text import WS, column, let, lines, utf16_length

#: Patterns that count path-like and complex parts, and the limits of the warnings.
_REST = f"[^{WS}{REFUSED}]+"
PATH_PATTERNS = (f"/{_REST}", f"[A-Za-z]:\\\\{_REST}", f"\\.\\.?/{_REST}")
QUOTED = "[\"'][^\"']*[\"']"
COMPLEX_PATTERNS = (
    "\\{[^{}]*\\{[^{}]*\\}[^{}]*\\}", "\\[[^\\[\\]]*\\[[^\\[\\]]*\\][^\\[\\]]*\\]", "/[^/\\n]+/[gimuy]*", "`[^`]*\\$\\{[^}]*\\}[^`]*`",
)
MANY_PATHS, MANY_COMPLEX = 1000, 100


def estimated_paths(content: Column | str) -> Column:
    """A cheap over-estimate of the number of paths."""
    c = column(content)
    quoted = F.filter(F.regexp_extract_all(c, F.lit(QUOTED), F.lit(0)), lambda q: q.rlike(r"[/\\]"))
    return sum((F.regexp_count(c, F.lit(p)) for p in PATH_PATTERNS), F.size(quoted))


def complex_patterns(content: Column | str) -> Column:
    first, *more = (F.regexp_count(column(content), F.lit(p)) for p in COMPLEX_PATTERNS)
    return sum(more, first)


def fits(content: Column | str, *, enabled: bool = True, max_units: int = 1_000_000, max_lines: int = 50_000) -> Column:
    """Whether a document proceeds, without its warnings."""
    return F.lit(True) if not enabled else utf16_length(F.coalesce(column(content), F.lit(""))) <= max_units


def admission(content: Column | str, *, enabled: bool = True, max_units: int = 1_000_000, max_lines: int = 50_000) -> Column:
    """struct(proceed, message, warnings) of a document.

    Texts of more than ``max_units`` UTF-16 code units are refused; long or complex
    ones proceed with warnings. Disabled, everything proceeds silently.
    """
    if not enabled:
        return F.struct(F.lit(True).alias("proceed"), F.lit("").alias("message"), F.array().cast("array<string>").alias("warnings"))
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    judged = lambda proceed, message, warnings: F.struct(F.lit(proceed).alias("proceed"), message.alias("message"), warnings.alias("warnings"))

    #: The messages.
    def refused(units: Column) -> Column:
        told = text("Safety threshold exceeded: File size (", units, f" bytes) exceeds safety threshold ({max_units} bytes)")
        return judged(False, told, F.array().cast("array<string>"))

    def warned(m: Column) -> Column:
        return F.array_compact(F.array(
            F.when(m["lines"] > max_lines, text("Large file detected: ", m["lines"], " lines (threshold: ", str(max_lines), ")")),
            F.when(m["paths"] > MANY_PATHS, text("Large number of paths detected: estimated ", m["paths"], " paths")),
            F.when(m["hard"] > MANY_COMPLEX, text("Complex patterns detected: ", m["hard"], " patterns")),
        ))

    def passed(warnings: Column) -> Column:
        told = F.when(F.size(warnings) > 0, text("Safety checks passed with ", F.size(warnings), " warnings")).otherwise("Safety checks passed")
        return judged(True, told, warnings)

    def of_text(c: Column) -> Column:
        # Each pattern runs once over a text, and over none that is refused.
        measures = F.struct(F.size(lines(c)).alias("lines"), estimated_paths(c).alias("paths"), complex_patterns(c).alias("hard"))
        return let(utf16_length(c), lambda units: F.when(units > max_units, refused(units)).otherwise(let(measures, lambda m: let(warned(m), passed))))

    return let(F.coalesce(column(content), F.lit("")), of_text)


def admit(docs: DataFrame, content: str = "content", *, allow_override: bool = False, **limits) -> DataFrame:
    """The documents that may be extracted; with ``allow_override`` all of them."""
    return docs if allow_override else docs.filter(fits(content, **limits))
