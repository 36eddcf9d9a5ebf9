"""Scalar functions against tables of cases."""

import pytest
from pyspark.sql import functions as F

from pathloom.functions import classify, errors, formats
from pathloom.functions import paths as P
from pathloom.functions import predicates as Q
from pathloom.operators.validate import format_errors
from pathloom.sources import documents as D


def check(rows, function, cases):
    assert rows(list(cases), function) == list(cases.values())


def test_normalize(rows):
    check(rows, P.normalize, {"C:\\a//b\\": "C:/a/b", "/": "/", "https://h/x": "https:/h/x", "": "", "//": "/", "a/": "a"})


def test_components(rows):
    got = rows(["/h/.bashrc", "/a/b.tar.gz", "/", "/a", "x.y", "a\\b\\"], P.components)
    assert [tuple(r) for r in got] == [("/h", ".bashrc", "bashrc", ""), ("/a", "b.tar.gz", "gz", "b.tar"), ("", "", "", ""), ("", "a", "", "a"), ("", "x.y", "y", "x"), ("a", "b", "", "b")]


def test_depth_pattern_naming_resolve(rows):
    check(rows, P.depth, {"/a//b/": 2, "": 0, "/": 0, "a/b/c": 3})
    check(rows, P.pattern, {"/ab1/c.d": "/XXX/X.X", "é-1": "é-X"})
    check(rows, P.naming, {"a_b": "snake_case", "a-b": "kebab-case", "aB": "camelCase", "AB": "UPPERCASE", "ab": "lowercase", "": "UPPERCASE", "123": "UPPERCASE"})
    check(rows, lambda c: P.resolve(F.lit("/a/b.js"), c), {"../c": "/a/../c", "/x/": "/x", "C:\\y": "C:/y"})
    check(rows, lambda c: P.posix_resolve(F.lit("/ws"), c), {"./a/../b//c": "/ws/b/c", "../../..": "/", "/x/./y": "/x/y", "": "/ws"})


def test_types(rows):
    check(rows, classify.detect, {"ftp://h": "url", "D:/x": "absolute", "a/b": "relative", "a/": "relative", "x.y": "file", "x.": "unknown", "abc": "unknown", " /x ": "absolute"})
    check(rows, classify.generic, {"//cdn": "absolute", "C:\\x": "absolute", "C:/x": "unknown", "file:///a": "url", "../a": "relative", "a.b": "file"})
    check(rows, classify.module, {"C:/x": "absolute", "@a/b": "unknown"})
    check(rows, classify.style, {"//cdn": "url", "file:///a.b": "file", "#a.b": "file"})
    check(rows, classify.markup, {"#a.b": "unknown", "/x": "absolute"})


def test_predicates(rows):
    check(rows, Q.is_path_strict, {"3.14": True, "10/12/2024": True, "/a b": False, "a": False, "/x": True, "a.b\n": False, "C:\\x": True, "x?": False})
    check(rows, Q.is_path_spaced, {"/a b": True, "./a b/c": True, "plain": False, "a b.c": True, "/x|y": False})
    check(rows, Q.is_path_json, {"1.0.0": False, "a.js": False, "one.txt": True, "a/b": False, "http://h/p q": False, "/a b": True})
    check(rows, Q.is_module_path, {"react": False, "./x": True, "C:/x": True, "/": False, "https://x": True})
    check(rows, Q.is_valid_path, {"a/b": True, "C:/x": False, "a/con": False, " ": False, "a/console": True, "https://x": False})
    check(rows, Q.is_path_safe, {"../x": False, "~/x": False, "/etc/x": False, "/home/x": True})
    check(rows, Q.is_directory_path, {"a/": True, "a/b": True, "a/b.c": False, "a": False})


def test_format_errors(rows):
    invalid, walk = "Path contains invalid characters", "Path contains traversal sequences (..)"
    check(rows, format_errors, {"": ["Path is empty"], "../CON?": [invalid, walk], "../CON": ["Path contains reserved names: CON", walk], "a/b": [], "x" * 261: ["Path exceeds maximum length (260 characters)"]})


def test_formats(rows):
    number = lambda f: lambda c: f(c.cast("double"))
    check(rows, number(formats.number_of_bytes), {"0": "0 Bytes", "1023": "1023 Bytes", "1536": "1.5 KB", "1048576": "1 MB"})
    check(rows, number(formats.duration), {"999": "999ms", "1500": "1.50s", "60000": "1.00m", "7200000": "2.00h"})
    check(rows, number(formats.throughput), {"999": "999 paths/s", "1500": "1.5K paths/s", "2500000": "2.5M paths/s"})
    check(rows, number(formats.percentage), {"0.5": "50.00%", "0.00125": "0.13%"})
    check(rows, lambda c: formats.listing(F.split(c, ",")), {"a": "a", "a,b": "a and b", "a,b,c": "a, b, and c"})
    check(rows, lambda c: formats.array(F.split(c, ",")), {"a,b,c": "a, b, c", "a,b,c,d": "a, b, ... and 2 more"})
    check(rows, formats.path, {"https://x": "URL: https://x", "$A/b": "Environment Variable: $A/b", "\\x": "Absolute Path: \\x", "x": "Path: x"})
    check(rows, formats.path_extension, {"a.b": "Extension: .b", "ab": "Extension: .ab", "a.": "No extension"})
    check(rows, lambda c: formats.message(c, F.lit("x"), F.lit(2)), {"{0} of {1} and {2}": "x of 2 and {2}"})
    check(rows, lambda c: formats.label(c, formats.PATH_TYPES), {"url": "URL", "odd": "odd"})
    check(rows, lambda c: formats.invalid_number(c, 1, 5), {"": "Value must be at least 1", "3": None, "x": "Please enter a valid number", "0x10": "Value must be at most 5"})
    check(rows, formats.invalid_url, {"": "URL cannot be empty", "http://x/y": None, "nope": "Please enter a valid URL", "mailto:a@b": None})


def test_errors(rows):
    check(rows, errors.categorize, {"Syntax": "parsing", "no access": "file-system", "setting": "configuration", "x": "operational"})
    check(rows, lambda c: errors.severity(c, F.lit("safety")), {"fatal": "critical", "error": "error", "warning": "warning", "x": "info"})
    check(rows, errors.error_type, {"parse": "path-parse-error", "odd": "unknown-error"})
    check(rows, lambda c: errors.recovery_options(c)["max_retries"], {"file-system": 3, "operational": 2, "parse": 0})
    check(rows, lambda c: errors.user_message(F.lit("m"), c), {"safety": "Safety threshold exceeded: m", "parse": "Failed to parse path values: unknown file", "odd": "Unknown error: m"})
    check(rows, P.sanitize_message, {"/home/me/x password: a Key=b": "/home/***/x password=*** key=***", "C:\\Users\\me\\x": "C:\\Users\\***\\x"})


@pytest.mark.parametrize("name,extension,kind,language", [("a.JS", ".js", "javascript", "javascript"), (".env", "", None, "dotenv"), (".env.local", ".local", None, "dotenv"), ("x.yml", ".yml", "yaml", "yaml"), ("x", "", None, "unknown")])
def test_file_names(rows, name, extension, kind, language):
    assert rows([name], D.file_extension) == [extension]
    assert rows([name], D.type_of_extension) == [kind]
    assert rows([name], D.language_of_file) == [language]


def test_error_constructors(rows):
    parsed = rows(["bad"], lambda c: errors.parse_error(c, line=F.lit(3)))[0]
    assert (parsed["category"], parsed["severity"], parsed["line"], parsed["column"], parsed["recovery_action"]) == ("parsing", "warning", 3, None, "skip")
    warned = rows(["big"], errors.safety_warning)[0]
    assert warned["severity"] == "medium" and warned["recoverable"] and warned["user_message"] == "Safety threshold exceeded: big"
