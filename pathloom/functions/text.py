"""String rules of the path model, written for Spark's regular expressions.

Lengths and columns count UTF-16 code units; white space is the Unicode set
below, whatever the engine's ``\\s`` means; patterns end with ``\\z``, so that a
closing newline is part of the value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space, as the inside of a character class.
WS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
SPACE, NOT_SPACE = f"[{WS}]", f"[^{WS}]"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """``c`` without white space at both ends."""
    return F.regexp_replace(column(c), f"^{SPACE}+|{SPACE}+\\z", "")


def utf16_length(c: Column | str) -> Column:
    """Number of UTF-16 code units."""
    c = column(c)
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, F.length(c)).otherwise((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))


def lines(content: Column | str) -> Column:
    """The lines of a text; carriage returns stay."""
    return F.split(column(content), "\n", -1)


def starts(c: Column, *prefixes: str) -> Column:
    """Whether ``c`` starts with one of the prefixes."""
    test = c.startswith(prefixes[0])
    for p in prefixes[1:]:
        test = test | c.startswith(p)
    return test


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also inside other higher-order functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Numbers that are summed up one by one; longer arrays are cut into pieces of this many.
_PIECE = 256


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it.

    An array grows by copying, so sums are carried within pieces and from piece to
    piece: n numbers cost n * _PIECE / 2 + (n / _PIECE)^2 / 2 copies.
    """

    def carried(array: Column, start: Column) -> Column:
        state = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out"))
        return F.aggregate(array, state, step)["out"]

    def in_pieces(array: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.size(array) - 1, F.lit(_PIECE)), lambda i: F.slice(array, i + 1, F.lit(_PIECE)))

        def joined(p: Column) -> Column:
            starts_at = carried(F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)), F.lit(0))
            return F.flatten(F.transform(F.arrays_zip(p.alias("piece"), starts_at.alias("start")), lambda z: carried(z["piece"], z["start"])))

        return let(pieces, joined)

    return let(numbers, lambda array: F.when(F.size(array) > _PIECE, in_pieces(array)).otherwise(carried(array, F.lit(0))))


def matches(line: Column, pattern: str, groups: list[int]) -> Column:
    """All matches of ``pattern``: array of (text, g0.., column), column 1-based in code units.

    Spark gives the matched texts but no offsets. A sole match begins where its text first
    occurs: were that before the match, the pattern would have matched there. With more of them
    the line split at the same pattern gives what lies between, so a match begins after all gaps
    and texts before it. Groups come from the text alone, which is the same for a pattern without
    look-around.
    """
    groups_of = lambda t: (F.regexp_extract(t, pattern, g).alias(f"g{i}") for i, g in enumerate(groups))
    found = lambda t, at: F.struct(t.alias("text"), *groups_of(t), at.alias("column"))

    def sole(texts: Column) -> Column:
        text = F.get(texts, F.lit(0))
        return F.array(let(F.instr(line, text), lambda at: found(text, F.when(F.octet_length(line) == F.length(line), at).otherwise(utf16_length(F.left(line, at - 1)) + 1))))

    def several(parts: Column) -> Column:
        units = lambda x: F.when(parts["plain"], F.length(x)).otherwise(utf16_length(x))
        gaps = F.transform(F.slice(parts["gaps"], F.lit(1), F.size(parts["texts"])), units)

        def placed(gap: Column) -> Column:
            before = sums_before(F.zip_with(gap, parts["texts"], lambda g, t: g + units(t)))
            at = F.zip_with(gap, before, lambda g, b: g + b + 1)
            return F.zip_with(parts["texts"], at, found)

        return let(gaps, placed)

    def located(texts: Column) -> Column:
        split = F.struct(texts.alias("texts"), F.split(line, pattern, -1).alias("gaps"), (F.octet_length(line) == F.length(line)).alias("plain"))
        return F.when(F.size(texts) == 1, sole(texts)).when(F.size(texts) > 1, let(split, several))

    none = F.struct(F.lit("").alias("text"), *(F.lit("").alias(f"g{i}") for i in range(len(groups))), F.lit(0).alias("column"))
    return F.coalesce(let(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), located), F.filter(F.array(none), lambda x: F.lit(False)))
