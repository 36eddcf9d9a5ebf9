"""Path extraction from record and tree formats: CSV, JSON, TOML, and generic trees.

Their parsers have no Spark counterpart that keeps order, duplicate keys and
ragged rows, so documents go through Arrow batches. What cannot be parsed has no
paths, and is no error unless asked for.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.predicates import SPACED, STRICT, TREE

#: Fixed value: white space as the path model sees it.
WHITE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
Found = tuple[str, int, int, str]


def _compiled(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern.removesuffix("\\z") + "\\Z")


_STRICT, _SPACED, _TREE = _compiled(STRICT), _compiled(SPACED), _compiled(TREE)
_DRIVE = re.compile(r"[A-Za-z]:\\")


def _units(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2


def path_type(value: str) -> str:
    if value.startswith(("http://", "https://", "file://")):
        return "url"
    if value.startswith("/") or _DRIVE.match(value):
        return "absolute"
    return "relative" if value.startswith(("./", "../")) else "file" if "." in value else "unknown"


def _looks(pattern: re.Pattern[str], least: int) -> Callable[[str], bool]:
    return lambda s: _units(s) >= least and pattern.match(s) is not None


strict, spaced, tree_like = _looks(_STRICT, 2), _looks(_SPACED, 2), _looks(_TREE, 3)


def in_order(node: dict) -> list[tuple[str, object]]:
    """Entries as an object lists them: array-index keys by number, then the others as they came."""
    numbers = [k for k in node if k.isascii() and k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1]
    if not numbers:
        return list(node.items())
    first = set(numbers)
    return [(k, node[k]) for k in sorted(numbers, key=int)] + [(k, v) for k, v in node.items() if k not in first]


def _refuse(name: str) -> None:
    raise ValueError(name)


def parse_json(text: str) -> object:
    if text.startswith("\ufeff"):
        raise ValueError("byte order mark")
    return json.loads(text, parse_constant=_refuse)


def walk_json(text: str) -> Iterator[Found]:
    stack: list[tuple[object, tuple[str, ...]]] = [(parse_json(text), ())]
    while stack:
        node, keys = stack.pop()
        if isinstance(node, str):
            if tree_like(node):
                yield node, 1, 1, "JSON " + (".".join(keys) if keys else "value")
        elif isinstance(node, list):
            stack += [(v, (*keys, f"[{i}]")) for i, v in reversed(list(enumerate(node)))]
        elif isinstance(node, dict):
            stack += [(v, (*keys, k)) for k, v in reversed(in_order(node))]


def walk_toml(text: str) -> Iterator[Found]:
    stack: list[tuple[bool, object]] = [(False, tomllib.loads(text.replace("\r\n", "\n")))]
    while stack:
        is_key, node = stack.pop()
        if isinstance(node, str):
            if spaced(node):
                yield node, 1, 1, "TOML key" if is_key else "TOML value"
        elif isinstance(node, list):
            stack += [(False, v) for v in reversed(node)]
        elif isinstance(node, dict):
            for k, v in reversed(in_order(node)):
                stack += [(False, v), (True, k)]


def walk_tree(text: str, root: str = "root") -> Iterator[Found]:
    """Any JSON tree: keys before their values, nulls and their keys left out."""
    stack: list[tuple[bool, object, str]] = [(False, parse_json(text), root)]
    while stack:
        is_key, node, at = stack.pop()
        if isinstance(node, str):
            if strict(node):
                yield node, 1, 1, at
        elif isinstance(node, list):
            stack += [(False, v, f"{at}[{i}]") for i, v in reversed(list(enumerate(node))) if v is not None]
        elif isinstance(node, dict):
            for k, v in reversed(in_order(node)):
                if v is not None:
                    stack += [(False, v, f"{at}.{k}"), (True, k, f"{at}.key")]


#: Fixed value: what is trimmed around cells and makes a line empty.
_TRIMMED = " \t\n\r\f"
_LINE_END = re.compile("\r\n|\n|\r")


def _records(text: str) -> Iterator[list[str]]:
    """The records of a comma-separated text. Empty lines are none; a quoted empty cell makes a record.

    The first line end outside quotes is the line end of the whole text. A quoted cell
    ends at a quote before a comma or line end, blanks aside; with anything else behind
    the quote the cell is taken as it stands, quotes included. An open quote is an error.
    """
    if '"' not in text:
        end = _LINE_END.search(text)
        for line in text.split(end.group()) if end else [text]:
            if line.strip(_TRIMMED):
                yield line.split(",")
        return
    end, at, size, stops = None, 0, len(text), re.compile("[,\r\n]")
    cells: list[str] = []
    quoted = False
    while True:
        start = at
        while at < size and text[at] in " \t\f" or (at < size and text[at] in "\r\n" and end is not None and text[at] not in end):
            at += 1
        whole = None
        if at < size and text[at] == '"':
            close = at + 1
            while True:
                close = text.find('"', close)
                if close < 0:
                    raise ValueError("quoted cell without an end")
                if text[close + 1 : close + 2] != '"':
                    break
                close += 2
            after = close + 1
            while after < size and text[after] in " \t\f":
                after += 1
            if after == size or text[after] in ",\r\n":
                whole, at = text[at + 1 : close].replace('""', '"'), after
        if whole is None:  # up to the next comma or line end
            found = stops.search(text, at)
            stop = found.start() if found else size
            cell, at = text[start:stop].strip(_TRIMMED), stop
        else:
            cell, quoted = whole, True
        if at < size and text[at] == ",":
            cells.append(cell)
            at += 1
            continue
        if end is None and at < size:
            end = _LINE_END.match(text, at).group()
            stops = re.compile(f",|{end}")
        if cells or quoted or cell:
            yield [*cells, cell]
        cells, quoted = [], False
        if at >= size:
            return
        at += len(end) if text.startswith(end, at) else 1


def walk_csv(text: str) -> Iterator[Found]:
    for record, cells in enumerate(_records(text.removeprefix("\ufeff")), 1):
        for i, cell in enumerate(cells, 1):
            if ("/" in cell or "." in cell or "\\" in cell) and strict(value := cell.strip(WHITE)):
                yield value, record, i, f"CSV cell [{record},{i}]"


WALKERS: dict[str, Callable[[str], Iterator[Found]]] = {"json": walk_json, "toml": walk_toml, "csv": walk_csv, "tree": walk_tree}
_FIELDS = [("ordinal", pa.int32()), ("value", pa.string()), ("path_type", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("context", pa.string())]


_LONE = re.compile("[\ud800-\udfff]")


def whole(text: str) -> str:
    """A text without half characters: escapes can name them, but UTF-8 cannot hold them."""
    return text if text.isascii() else _LONE.sub("\ufffd", text)


def found_in(kind: str, text: str | None) -> tuple[list[Found], str | None]:
    """A document's paths, and the parser's message if it failed."""
    if not text or not text.strip(WHITE):
        return [], None
    try:
        return [(whole(value), line, at, whole(context)) for value, line, at, context in WALKERS[kind](text)], None
    except (ValueError, RecursionError) as failed:
        return [], whole(str(failed))


_PATH = pa.struct([("value", pa.string()), ("path_type", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("context", pa.string())])
_RESULT = pa.struct([("paths", pa.list_(_PATH)), ("message", pa.string())])


_FOUND = T.StructType([T.StructField(n, T.IntegerType() if n in ("line", "column") else T.StringType()) for n in ("value", "path_type", "line", "column", "context")])


@arrow_udf(T.StructType([T.StructField("paths", T.ArrayType(_FOUND)), T.StructField("message", T.StringType())]))
def tree_result(kind: pa.Array, content: pa.Array) -> pa.Array:
    """(paths, parser's message) of texts of the kinds of ``WALKERS``; rows of other kinds are null."""
    out = []
    for name, text in zip(kind, content, strict=True):
        name = name.as_py()
        if name not in WALKERS:
            out.append(None)
            continue
        found, failed = found_in(name, text.as_py())
        paths = [{"value": v, "path_type": path_type(v), "line": line, "column": at, "context": context} for v, line, at, context in found]
        out.append({"paths": paths, "message": failed})
    return pa.array(out, _RESULT)


#: Bytes of an Arrow batch of documents.
BATCH_BYTES = 16_000_000


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches are bounded in bytes; a session's own bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if docs.sparkSession.conf.get(key, None) is None:
        docs.sparkSession.conf.set(key, str(BATCH_BYTES))
    return docs


def extract_tree(docs: DataFrame, kind: str, content: str = "content", *, report_parse_errors: bool = False) -> DataFrame:
    """Paths of csv, json, toml or tree documents: (doc_id, ordinal, value, path_type, line, column, context).

    With ``report_parse_errors`` a document that cannot be parsed has one row with
    ordinal -1 and the message as context.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, ordinal int, value string, path_type string, line int, column int, context string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, columns = [], [[] for _ in _FIELDS]
            for i, text in enumerate(batch.column(1)):
                found, failed = found_in(kind, text.as_py())
                rows = [(n, v, path_type(v), line, col, context) for n, (v, line, col, context) in enumerate(found)]
                if failed is not None and report_parse_errors:
                    rows.append((-1, None, None, None, None, failed))
                owners += [i] * len(rows)
                for column, values in zip(columns, zip(*rows, strict=True), strict=False):
                    column += values
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *arrays], names=["doc_id", *(n for n, _ in _FIELDS)])

    return bounded(docs).select("doc_id", content).mapInArrow(run, schema)
