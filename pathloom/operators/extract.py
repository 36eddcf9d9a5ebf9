"""Path extraction from line-oriented formats, as expressions over one text column.

Each ``*_paths`` function turns a content column into an array of path structs in
order of emission. Nothing is shuffled and no Python runs, so the same expressions
serve tables and streams. A null or blank text gives an empty array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.predicates import is_data_url, is_javascript_url, is_module_path, is_path_spaced
from ..functions.text import NOT_SPACE, SPACE, WS, column, let, lines, matches, trim
from ..schema import PATH_ARRAY

#: Attributes that hold paths, and the patterns of the formats.
ATTRIBUTES = ("src", "href", "data", "action", "poster", "background", "cite", "formaction", "icon", "manifest", "srcset")
HTML = f"(?i)({'|'.join(ATTRIBUTES)}){SPACE}*={SPACE}*[\"']([^\"']+)[\"']"
CSS_URL = f"(?i)url{SPACE}*\\({SPACE}*['\"]?([^'\"()]+?)['\"]?{SPACE}*\\)"
CSS_IMPORT = f"(?i)@import{SPACE}+(?:url{SPACE}*\\({SPACE}*)?['\"]([^'\"]+)['\"](?:{SPACE}*\\))?"
_NAMES = f"(?:[\\w{{}},*{WS}]+{SPACE}+from{SPACE}+)?['\"]([^'\"]+)['\"]"
_CALL = f"{SPACE}*\\({SPACE}*['\"]([^'\"]+)['\"]{SPACE}*\\)"
MODULES = (f"import{SPACE}+{_NAMES}", f"import{_CALL}", f"require{_CALL}", f"export{SPACE}+{_NAMES}")


def _none() -> Column:
    return F.array().cast(PATH_ARRAY)


def _path(value: Column, kind: Column, line: Column, at: Column, context: Column) -> Column:
    return F.struct(value.alias("value"), kind.alias("path_type"), line.alias("line"), at.alias("column"), context.alias("context"))


def _by_line(content: Column, found: Callable[[Column, Column], Column], hint: str) -> Column:
    """Paths of all lines that match ``hint``, a cheap test that every line with a path passes."""
    each = F.transform(lines(content), lambda text, i: F.when(text.rlike(hint), found(text, i + 1)).otherwise(_none()))
    return F.when(content.rlike(hint), F.flatten(each)).otherwise(_none())


def html_paths(content: Column | str) -> Column:
    def found(text: Column, line: Column) -> Column:
        def one(m: Column) -> Column:
            name, value, at = F.lower(m["g0"]), m["g1"], m["column"]
            context = F.concat(F.lit("HTML "), name)
            parts = F.transform(F.split(value, ",", -1), lambda p: F.regexp_extract(trim(p), f"\\A({NOT_SPACE}*)", 1))
            usable = F.filter(parts, lambda p: (p != "") & ~is_data_url(p))
            several = F.transform(usable, lambda p: _path(p, classify.markup(p), line, at, context))
            single = F.when(is_data_url(value) | is_javascript_url(value), _none()).otherwise(
                F.array(_path(value, classify.markup(value), line, at, context))
            )
            return F.when(name == "srcset", several).otherwise(single)

        return F.flatten(F.transform(matches(text, HTML, [1, 2]), one))

    return _by_line(column(content), found, f"={SPACE}*[\"']")


def css_paths(content: Column | str) -> Column:
    def found(text: Column, line: Column) -> Column:
        def paths(pattern: str, context: str, data: bool) -> Column:
            rows = F.transform(matches(text, pattern, [1]), lambda m: F.struct(trim(m["g0"]).alias("value"), m["column"].alias("column")))
            kept = F.filter(rows, lambda r: (r["value"] != "") & (F.lit(data) | ~is_data_url(r["value"])))
            return F.transform(kept, lambda r: _path(r["value"], classify.style(r["value"]), line, r["column"], F.lit(context)))

        imports = text.rlike("@import(?![A-Za-z0-9_])")
        return F.when(imports, paths(CSS_IMPORT, "CSS @import", True)).otherwise(paths(CSS_URL, "CSS url()", False))

    return _by_line(column(content), found, "(?i)@import|url")


def javascript_paths(content: Column | str) -> Column:
    def kind(text: Column) -> Column:
        return (
            F.when(text.contains("require"), "JS require").when(text.contains("export"), "JS export")
            .when(text.contains("import("), "JS dynamic import").otherwise("JS import")
        )

    def found(text: Column, line: Column) -> Column:
        none = F.array().cast("array<struct<text: string, g0: string, column: int>>")
        every = F.concat(*(F.when(text.contains(p[:6]), matches(text, p, [1])).otherwise(none) for p in MODULES))
        kept = F.filter(every, lambda m: is_module_path(m["g0"]))
        return F.transform(kept, lambda m: _path(m["g0"], classify.module(m["g0"]), line, m["column"], kind(m["text"])))

    return _by_line(column(content), found, "import|require|export")


def dotenv_paths(content: Column | str) -> Column:
    dot = "[^\\n\\r\\u2028\\u2029]"
    plain, in_quotes = f"\\A([^=]+)=({dot}*)\\z", f"\\A[\"']([^\"']+)[\"']=({dot}*)\\z"
    unquoted = lambda v: F.replace(trim(F.regexp_replace(v, "\\A[\"']|[\"']\\z", "")), F.lit("\\\\"), F.lit("\\"))

    def found(raw: Column, line: Column) -> Column:
        """Each part of a line is worked out once, and a line's last three candidates only if it may have them."""
        return let(trim(raw), lambda text: F.when(text.startswith("#"), _none()).otherwise(let(parts(text), lambda p: paths(p, line))))

    def parts(text: Column) -> Column:
        quoted = F.when(text.rlike("\\A[\"']"), text)
        return F.struct(
            F.regexp_extract(text, plain, 1).alias("name"), F.regexp_extract(text, plain, 2).alias("value"), (F.instr(text, "=")).alias("at"),
            F.coalesce(F.regexp_extract(quoted, in_quotes, 1), F.lit("")).alias("quoted"), F.coalesce(F.regexp_extract(quoted, in_quotes, 2), F.lit("")).alias("rest"),
        )

    def paths(p: Column, line: Column) -> Column:
        def one(value: Column, at: Column, context: Column) -> Column:
            return F.when(is_path_spaced(value), _path(value, classify.generic(value), line, at, context))

        def candidates(key: Column) -> Column:
            variable = lambda name: F.concat(F.lit("Environment variable: "), name)
            name = F.lit("Environment variable name")
            first = (let(unquoted(p["value"]), lambda v: one(v, p["at"], variable(key))), one(key, F.lit(1), name))
            more = (one(p["quoted"], F.lit(1), name), let(unquoted(p["rest"]), lambda v: one(v, p["at"], variable(p["quoted"]))))
            both = (p["quoted"] != "") & (p["rest"] != "")
            return F.array_compact(F.when(both, F.array(*first, *more)).otherwise(F.array(*first)))

        return F.when((p["name"] == "") | (p["value"] == ""), _none()).otherwise(let(trim(p["name"]), candidates))

    return _by_line(column(content), found, "=")


NATIVE: dict[str, Callable[[Column | str], Column]] = {"html": html_paths, "css": css_paths, "javascript": javascript_paths, "dotenv": dotenv_paths}


def explode_paths(docs: DataFrame, paths: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a path: (*keep, ordinal, value, path_type, line, column, context).

    An outer explode: for an inner one Spark tests the array's size before, and extracts twice.
    """
    rows = docs.select(*keep, F.posexplode_outer(paths).alias("ordinal", "_path")).filter(F.col("ordinal").isNotNull())
    return rows.select(*keep, "ordinal", "_path.*")


def extract(docs: DataFrame, kind: str, content: str = "content", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Paths of the documents of one native format."""
    return explode_paths(docs, NATIVE[kind](content), keep)
