"""Whether a string looks like, or is fit to be, a path: boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, column, starts, trim, utf16_length

#: Characters no path holds, and device names no segment may have.
REFUSED = "\"'<>|*?"
INVALID = '<>:"|?*'
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
RESERVED_PATTERN = f"(?i)\\A({'|'.join(RESERVED)})\\z"


def _shapes(inner: str, url: str, extension: str, pairs: bool) -> str:
    kinds = [f"/[{inner}]+", f"[A-Za-z]:\\\\[{inner}]+", f"\\.\\.?/[{inner}]+", f"https?://[{url}]+", f"file://[{url}]+", extension]
    return f"\\A(?:{'|'.join([*kinds, f'[{inner}]+/[{inner}]+'] if pairs else kinds)})\\z"


_TIGHT, _LOOSE = f"^{WS}{REFUSED}", f"^{REFUSED}"
STRICT = _shapes(_TIGHT, _TIGHT, f"[{_TIGHT}]+\\.[a-zA-Z0-9]+", True)
SPACED = _shapes(_LOOSE, _LOOSE, f"[{_LOOSE}]+\\.[a-zA-Z0-9]+", True)
TREE = _shapes(_LOOSE, _TIGHT, f"[{_TIGHT}/\\\\]{{3,}}\\.[a-zA-Z]{{2,}}", False)
MODULE = "\\A(?:\\./|\\.\\./|/|[A-Za-z]:[/\\\\]|https?://|file://)"


def is_path_strict(c: Column | str) -> Column:
    """Path-like without any white space: table cells and generic trees."""
    return column(c).isNotNull() & (utf16_length(c) >= 2) & column(c).rlike(STRICT)


def is_path_spaced(c: Column | str) -> Column:
    """Path-like, spaces allowed: environment files and TOML."""
    return column(c).isNotNull() & (utf16_length(c) >= 2) & column(c).rlike(SPACED)


def is_path_json(c: Column | str) -> Column:
    """Path-like in JSON: no bare a/b, and file names of three characters and a two-letter extension."""
    return column(c).isNotNull() & (utf16_length(c) >= 3) & column(c).rlike(TREE)


def is_module_path(c: Column | str) -> Column:
    """A module specifier that names a place and not a package."""
    return (utf16_length(c) >= 2) & column(c).rlike(MODULE)


def is_data_url(c: Column | str) -> Column:
    return column(c).startswith("data:")


def is_javascript_url(c: Column | str) -> Column:
    return column(c).startswith("javascript:")


def segments(c: Column | str) -> Column:
    return F.split(column(c), r"[/\\]", -1)


def is_valid_path(c: Column | str) -> Column:
    """Not blank, without invalid characters, and no segment a device name."""
    c = column(c)
    return (F.length(trim(c)) > 0) & ~c.rlike(f"[{INVALID}]") & ~F.exists(segments(c), lambda s: s.rlike(RESERVED_PATTERN))


def is_absolute_path(c: Column | str) -> Column:
    return column(c).rlike(r"\A(?:/|[A-Za-z]:[\\/])")


def is_relative_path(c: Column | str) -> Column:
    return ~is_absolute_path(c) & column(c).rlike(r"[/\\]")


def is_file_path(c: Column | str) -> Column:
    from .paths import written_extension

    return F.length(written_extension(c)) > 0


def is_directory_path(c: Column | str) -> Column:
    c = column(c)
    return c.endswith("/") | c.endswith("\\") | (~is_file_path(c) & c.rlike(r"[/\\]"))


def is_path_safe(c: Column | str) -> Column:
    """No parent steps, no home shortcut, and not in a system folder."""
    c = column(c)
    return ~(c.contains("..") | c.contains("~") | starts(c, "/etc/", "/sys/", "C:\\Windows\\"))


def is_notification_level(c: Column | str) -> Column:
    return column(c).isin("all", "important", "silent")


def is_preset(c: Column | str) -> Column:
    return column(c).isin("minimal", "balanced", "comprehensive", "performance", "validation")


def is_safe_value(kind: Column | str) -> Column:
    """Whether a value of this JSON type may be a setting."""
    return ~column(kind).isin("object", "function", "symbol")


def should_cancel(processed: Column | str, threshold: int, elapsed_ms: Column | str, max_ms: int = 30_000) -> Column:
    return (column(processed) > threshold) | (column(elapsed_ms) > max_ms)
