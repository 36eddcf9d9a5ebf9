"""Numbers, times, lists and labels as display strings: columns in, string columns out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column, starts

#: Display labels.
PATH_TYPES = {"file": "File", "directory": "Directory", "relative": "Relative Path", "absolute": "Absolute Path", "url": "URL", "unknown": "Unknown Type"}
STATUSES = {"valid": "Valid", "invalid": "Invalid", "broken": "Broken", "inaccessible": "Inaccessible"}
FILE_TYPES = {
    "json": "JSON", "yaml": "YAML", "yml": "YAML", "javascript": "JavaScript", "typescript": "TypeScript", "log": "Log File",
    "ini": "INI File", "unknown": "Unknown",
}
OUTPUT_FORMATS = {"text": "Plain Text", "json": "JSON", "csv": "CSV"}
SIZES = ("Bytes", "KB", "MB", "GB", "TB")


def _fixed(c: Column, digits: int) -> Column:
    """Exactly ``digits`` decimals of a double, its binary value rounded to nearest, ties away from zero."""
    x = c.cast("double")
    twice = F.abs(x) * 2 * 10**digits
    tie = (twice == F.floor(twice)) & (F.pmod(twice, F.lit(2.0)) == 1) & (x * 2 ** (digits + 1) == F.floor(x * 2 ** (digits + 1)))
    return F.replace(F.format_number(F.when(tie, x + F.signum(x) * 10.0 ** -(digits + 3)).otherwise(x), digits), F.lit(","), F.lit(""))


def _short(c: Column) -> Column:
    """Two decimals at most, without closing zeros."""
    return F.regexp_replace(F.regexp_replace(_fixed(c, 2), "0+\\z", ""), "\\.\\z", "")


def message(template: Column | str, *args: Column) -> Column:
    """``{n}`` replaced by the n-th argument; places without an argument (or with a null one) stay."""
    out = column(template)
    for i, arg in enumerate(args):
        out = F.replace(out, F.lit(f"{{{i}}}"), F.coalesce(arg.cast("string"), F.lit(f"{{{i}}}")))
    return out


def number_of_bytes(c: Column | str) -> Column:
    c = column(c)
    step = F.floor(F.log(c.cast("double")) / F.log(F.lit(1024.0))).cast("int")
    step = F.least(F.greatest(step, F.lit(0)), F.lit(len(SIZES) - 1))  # beyond the last unit the number grows
    unit = F.element_at(F.array(*map(F.lit, SIZES)), step + 1)
    return F.when(c == 0, "0 Bytes").otherwise(F.concat(_short(c / F.pow(F.lit(1024.0), step)), F.lit(" "), unit))


def _plain(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "\\.0\\z", "")


def duration(ms: Column | str) -> Column:
    ms = column(ms)
    return (
        F.when(ms < 1000, F.concat(_plain(ms), F.lit("ms"))).when(ms < 60_000, F.concat(_fixed(ms / 1000, 2), F.lit("s")))
        .when(ms < 3_600_000, F.concat(_fixed(ms / 60_000, 2), F.lit("m"))).otherwise(F.concat(_fixed(ms / 3_600_000, 2), F.lit("h")))
    )


def throughput(c: Column | str, unit: str = "paths/s") -> Column:
    c = column(c)
    return (
        F.when(c < 1000, F.concat(_fixed(c, 0), F.lit(f" {unit}"))).when(c < 1_000_000, F.concat(_fixed(c / 1000, 1), F.lit(f"K {unit}")))
        .otherwise(F.concat(_fixed(c / 1_000_000, 1), F.lit(f"M {unit}")))
    )


def count(c: Column | str) -> Column:
    return F.format_number(column(c), 0)


def percentage(c: Column | str) -> Column:
    return F.concat(_fixed(column(c) * 100, 2), F.lit("%"))


def relative_time(ms: Column | str, now_ms: Column | str) -> Column:
    """The largest whole unit since ``ms``; ``now_ms`` is an input, so that results repeat."""
    seconds = F.floor((column(now_ms) - column(ms)) / 1000)
    out = None
    for size, name in ((86_400, "day"), (3_600, "hour"), (60, "minute"), (1, "second")):
        n = F.floor(seconds / size)
        text = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
        out = F.when(n > 0, text) if out is None else out.when(n > 0, text)
    return out.otherwise("just now")


def _listing(items: Column, last: str) -> Column:
    size = F.size(items)
    return F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(size - 1, F.lit(0))), ", "), F.lit(last), F.element_at(items, -1))


def listing(items: Column | str, conjunction: str = "and") -> Column:
    items = column(items)
    size = F.size(items)
    return (
        F.when(size == 0, "").when(size == 1, F.try_element_at(items, F.lit(1)))
        .when(size == 2, F.array_join(items, f" {conjunction} ")).otherwise(_listing(items, f", {conjunction} "))
    )


def boolean(c: Column | str) -> Column:
    return F.when(column(c), "Yes").otherwise("No")


def _some(items: Column, empty: str) -> Column:
    size = F.size(items)
    more = F.concat(F.array_join(F.slice(items, 1, 2), ", "), F.lit(", ... and "), (size - 2).cast("string"), F.lit(" more"))
    return F.when(size == 0, empty).when(size <= 3, F.array_join(items, ", ")).otherwise(more)


def array(items: Column | str) -> Column:
    return _some(column(items), "None")


def entries(c: Column | str) -> Column:
    """A map of strings, its first five entries."""
    return _braced(column(c), lambda v: F.coalesce(v, F.lit("null")))


def nested_entries(c: Column | str) -> Column:
    """A map of maps of strings, the first five entries of each; the inner ones in braces of their own."""
    return _braced(column(c), lambda v: F.coalesce(entries(v), F.lit("null")))


def _braced(c: Column, show: Callable[[Column], Column]) -> Column:
    size = F.cardinality(c)
    pairs = F.transform(F.slice(F.map_entries(c), 1, 5), lambda e: F.concat(e["key"], F.lit(": "), show(e["value"])))
    shown = F.array_join(pairs, ", ")
    more = F.concat(F.lit("{"), shown, F.lit(", ... and "), (size - 5).cast("string"), F.lit(" more}"))
    return F.when(size == 0, "{}").when(size > 5, more).otherwise(F.concat(F.lit("{"), shown, F.lit("}")))


def path(c: Column | str) -> Column:
    c = column(c)
    labels = (
        (starts(c, "http://", "https://"), "URL: "), (c.startswith("file://"), "File URL: "), (c.contains("$"), "Environment Variable: "),
        (starts(c, "/", "\\"), "Absolute Path: "), (starts(c, "./", "../"), "Relative Path: "),
    )
    label = reduce(lambda out, r: out.when(*r), labels[1:], F.when(*labels[0])).otherwise("Path: ")
    return F.concat(label, c)


def label(c: Column | str, names: dict[str, str]) -> Column:
    """The display label of a value, itself if it has none."""
    c = column(c)
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def permissions(c: Column | str) -> Column:
    c = column(c)
    return F.when(c.isNull() | (c == ""), "No permissions").otherwise(F.concat(F.lit("Permissions: "), c))


def path_depth(c: Column | str) -> Column:
    return F.concat(F.lit("Depth: "), (F.size(F.split(column(c), r"[/\\]", -1)) - 1).cast("string"))


def path_extension(c: Column | str) -> Column:
    last = F.element_at(F.split(column(c), r"\.", -1), -1)
    return F.when(last == "", "No extension").otherwise(F.concat(F.lit("Extension: ."), last))


def path_pattern(c: Column | str) -> Column:
    return F.concat(F.lit("Pattern: "), column(c))


def path_examples(items: Column | str) -> Column:
    items = column(items)
    size = F.size(items)
    return F.when(size == 0, "No examples").when(size == 1, F.concat(F.lit("Example: "), F.try_element_at(items, F.lit(1)))).otherwise(
        F.concat(F.lit("Examples: "), _some(items, ""))
    )


def invalid_number(c: Column | str, least: float | None = None, most: float | None = None) -> Column:
    """The message about a typed number, or null; blank counts as 0."""
    from .text import trim

    text = trim(c)
    hexadecimal = text.rlike("\\A0[xX][0-9a-fA-F]+\\z")
    decimal = text.rlike("\\A[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?\\z|\\A[+-]?Infinity\\z")
    value = F.when(text == "", 0.0).when(hexadecimal, F.conv(F.substring(text, 3, 16), 16, 10).cast("double")).when(decimal, F.expr("1") * text.try_cast("double"))
    out = F.when(value.isNull(), "Please enter a valid number")
    show = lambda x: str(int(x)) if float(x).is_integer() else str(x)
    if least is not None:
        out = out.when(value < least, f"Value must be at least {show(least)}")
    return out.when(value > most, f"Value must be at most {show(most)}") if most is not None else out


def invalid_url(c: Column | str) -> Column:
    """The message about a typed URL, or null: a scheme, and where the scheme needs them a host and a port that can be."""
    from .text import trim

    c = column(c)
    web, t = "\\A(?i:https?|wss?|ftp):[/\\\\]*", trim(c)
    authority = F.regexp_extract(t, f"{web}([^/\\\\?#]*)", 1)
    host = authority.rlike("\\A(?:.*@)?(?:\\[[0-9a-fA-F:.]+\\]|[^\\s#%/:<>?@\\[\\\\\\]^|]+)(?::[0-9]*)?\\z")
    port = F.coalesce(F.regexp_extract(authority, ":([0-9]+)\\z", 1).try_cast("double"), F.lit(0.0))
    other = t.rlike("\\A(?i:file:|(?!https?:|wss?:|ftp:)[a-z][a-z0-9+.-]*:)")
    good = F.when(t.rlike(web), host & (port <= 65_535)).otherwise(other)
    return F.when(c.isNull() | (F.length(t) == 0), "URL cannot be empty").when(~good, "Please enter a valid URL")
