"""Extractors against hand-made cases: values, types, positions, contexts, order of emission."""

import re

import pytest
from pyspark.sql import functions as F

from pathloom.operators import settings
from pathloom.operators.extract import NATIVE, extract
from pathloom.operators.trees import extract_tree
from pathloom.plans.engine import extract_documents, native_paths

CASES = {
    "html": (
        '<img src="./a.png" data-src=\'b.png\'>\n<a HREF = "#top">t</a><a href="javascript:x()">j</a>\n<img srcset="s.jpg 1x, //cdn/x@2x.jpg 2x">\n'
        '<img srcset="data:image/png;base64,AAA 1x">\n<link href="file:///c/d.css"><a href="it\'s">q</a>',
        [
            ("./a.png", "relative", 1, 6, "HTML src"), ("b.png", "file", 1, 25, "HTML src"), ("#top", "unknown", 2, 4, "HTML href"),
            ("s.jpg", "file", 3, 6, "HTML srcset"), ("//cdn/x@2x.jpg", "url", 3, 6, "HTML srcset"), ("AAA", "unknown", 4, 6, "HTML srcset"),
            ("file:///c/d.css", "file", 5, 7, "HTML href"), ("it", "unknown", 5, 33, "HTML href"),
        ],
    ),
    "css": (
        '@import "./base.css"; a{b:url(x.png)}\n@import url(theme.css);\na{b:url( \'/i/a.png\' ), URL(c.woff)} /* url(d) */\nb{c:url("data:x,y")} c{d:url(//h/e.svg)}',
        [
            ("./base.css", "relative", 1, 1, "CSS @import"), ("/i/a.png", "absolute", 3, 5, "CSS url()"), ("c.woff", "file", 3, 24, "CSS url()"),
            ("d", "unknown", 3, 40, "CSS url()"), ("//h/e.svg", "url", 4, 26, "CSS url()"),
        ],
    ),
    "javascript": (
        "const a = require('./r'); import b from './i';\nimport c from './my-require'; import d from 'react';\nimport ('./lazy'); import('./dyn');\n"
        "export * from 'C:/lib/x';\nimport $ from './dollar';\nimport {\n  e\n} from './multi';",
        [
            ("./i", "relative", 1, 27, "JS import"), ("./r", "relative", 1, 11, "JS require"), ("./my-require", "relative", 2, 1, "JS require"),
            ("./lazy", "relative", 3, 1, "JS import"), ("./dyn", "relative", 3, 20, "JS dynamic import"), ("C:/lib/x", "absolute", 4, 1, "JS export"),
        ],
    ),
    "dotenv": (
        '# c=./no\nA=./x/y\n  B="C:\\\\d\\\\e.db"\n"./k.env"=/v/w\nV=1.2.3\nE=',
        [
            ("./x/y", "relative", 2, 2, "Environment variable: A"), ("C:\\d\\e.db", "absolute", 3, 2, "Environment variable: B"),
            ("/v/w", "absolute", 4, 10, 'Environment variable: "./k.env"'), ("./k.env", "relative", 4, 1, "Environment variable name"),
            ("/v/w", "absolute", 4, 10, "Environment variable: ./k.env"), ("1.2.3", "file", 5, 2, "Environment variable: V"),
        ],
    ),
    "json": (
        '{"b":"./x","2":"/two","1":["one.txt","a/b",{"c":"1.0.0"}],"u":"http://h/p q","d":"./dup","d":"../last"}',
        [("one.txt", "file", 1, 1, "JSON 1.[0]"), ("/two", "absolute", 1, 1, "JSON 2"), ("./x", "relative", 1, 1, "JSON b"), ("../last", "relative", 1, 1, "JSON d")],
    ),
    "toml": (
        'p = "./a b"\nn = 3.14\n["x/y"]\nl = ["C:\\\\q", "plain"]\n',
        [("./a b", "relative", 1, 1, "TOML value"), ("x/y", "unknown", 1, 1, "TOML key"), ("C:\\q", "absolute", 1, 1, "TOML value")],
    ),
    "csv": (
        'name,path\n\nr1,./a,extra/x\n"q","/m n",3.14\n10/12/2024, ../z ',
        [
            ("./a", "relative", 2, 2, "CSV cell [2,2]"), ("extra/x", "unknown", 2, 3, "CSV cell [2,3]"), ("3.14", "file", 3, 3, "CSV cell [3,3]"),
            ("10/12/2024", "unknown", 4, 1, "CSV cell [4,1]"), ("../z", "relative", 4, 2, "CSV cell [4,2]"),
        ],
    ),
}


def found(spark, kind, content):
    docs = spark.createDataFrame([(1, content)], "doc_id long, content string")
    out = extract(docs, kind) if kind in NATIVE else extract_tree(docs, kind)
    return [tuple(r)[2:] for r in out.orderBy("ordinal").collect()]


@pytest.mark.parametrize("kind", CASES)
def test_cases(spark, kind):
    content, expected = CASES[kind]
    assert found(spark, kind, content) == expected


@pytest.mark.parametrize("kind", [*CASES, "tree"])
@pytest.mark.parametrize("content", [None, "", " \n\t ", "no references"])
def test_nothing_to_find(spark, kind, content):
    assert found(spark, kind, content) == []


def test_columns_count_utf16_units(spark):
    assert found(spark, "html", '😀<a href="x"> é<img src="./y">') == [("x", "unknown", 1, 6, "HTML href"), ("./y", "relative", 1, 22, "HTML src")]


def test_quoted_key_with_equals_sign(spark):
    assert found(spark, "dotenv", '"a=b"=/v/x') == [("/v/x", "absolute", 1, 3, "Environment variable: a=b")]


@pytest.mark.parametrize("bad", ["{", '{"a": NaN}', '// c\n{"a":"/x/y"}', '\ufeff{"a":"/x/y"}', '["./a",]'])
def test_json_that_does_not_parse_has_no_paths(spark, bad):
    assert found(spark, "json", bad) == []


def test_deep_json(spark):
    assert found(spark, "json", "[" * 300 + '"./deep"' + "]" * 300)[0][0] == "./deep"


def test_tree_emits_keys_first_and_skips_nulls(spark):
    content = '{"a/b": ["./x", null], "c/d": null, "0": "/z/y"}'
    assert [(v, c) for v, _, _, _, c in found(spark, "tree", content)] == [("/z/y", "root.0"), ("a/b", "root.key"), ("./x", "root.a/b[0]")]


def test_engine_routes_and_reports(spark):
    docs = spark.createDataFrame(
        [(1, "html", '<a href="/x">'), (2, "yaml", "a: ./b"), (3, "jsonc", "// no"), (4, "env", "A=/x"), (5, None, "x"), (6, "scss", "")],
        "doc_id long, language_id string, content string",
    )
    out = extract_documents(docs)
    assert sorted(tuple(r) for r in out.results.collect()) == [(1, True, 1), (2, False, 0), (3, True, 0), (4, True, 1), (5, False, 0), (6, True, 0)]
    errors = {r["doc_id"]: r for r in out.errors.collect()}
    assert set(errors) == {2, 5} and errors[2]["category"] == "format" and errors[2]["recovery_action"] == "none"
    told = extract_documents(docs, report_parse_errors=True)
    assert {r["doc_id"] for r in told.errors.collect()} == {2, 3, 5}


def test_native_plan_has_no_exchange_and_no_python(spark):
    docs = spark.createDataFrame([(1, "html", "x")], "doc_id long, language_id string, content string")
    plan = docs.select(F.explode(native_paths("language_id", "content")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, content string, value string, line int")
    assert extract(docs, "html").count() == 0 and extract_tree(docs, "csv").count() == 0


def test_engine_reads_its_input_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(MIXED)], "doc_id long, language_id string, content string")
    docs.write.parquet(f"{tmp_path}/docs")
    found = extract_documents(spark.read.parquet(f"{tmp_path}/docs"), report_parse_errors=True)
    for df in (found.paths, found.errors, found.results):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert {r["doc_id"]: (r["success"], r["n_paths"]) for r in found.results.collect()} == {0: (True, 1), 1: (True, 2), 2: (False, 0), 3: (False, 0), 4: (True, 1), 5: (True, 0)}
    assert {r["doc_id"]: r["category"] for r in found.errors.collect()} == {2: "parsing", 3: "format"}
    assert [r["value"] for r in extract_documents(docs, dedupe=True).paths.filter("doc_id = 1").collect()] == ["/xy"]


MIXED = [("html", '<a href="./a">'), ("json", '["/xy", "/xy"]'), ("toml", "a = "), ("yaml", "a: ./b"), ("csv", "./a/b"), ("css", None)]


@pytest.mark.parametrize("accent", ["e", "é", "\U0001f600"])
def test_offsets_on_one_long_line(spark, accent):
    """More matches than fit in one piece of the running sum, by one and by many."""
    for n in (255, 256, 257, 700):
        line = "".join(f'<a href="./p{i}">{accent}</a>' for i in range(n))
        got = [r["column"] for r in extract(spark.createDataFrame([(1, line)], "doc_id long, content string"), "html").orderBy("ordinal").collect()]
        units = line.encode("utf-16-le")
        assert got == [len(line[: m.start()].encode("utf-16-le")) // 2 + 1 for m in re.finditer("href", line)] and len(units) > 0


def test_csv_records():
    from pathloom.operators.trees import _records

    cases = {
        '""\n./a/b': [[""], ["./a/b"]], 'a,b\n\n ,\n"x, y",z': [["a", "b"], ["", ""], ["x, y", "z"]], '"a"b,c\nd': [['"a"b', "c"], ["d"]],
        '"q","/m n",3.5\r\nx\r\n\r\n"l1\nl2",z': [["q", "/m n", "3.5"], ["x"], ["l1\nl2", "z"]], '"a""b",c': [['a"b', "c"]], "\n\n": [], "a,b,\n": [["a", "b", ""]],
        ' \t \n"a"\n': [["a"]], 'x"y"\n"z"': [['x"y"'], ["z"]], '"a\r\nb"\r\nc': [["a\r\nb"], ["c"]],
    }
    assert {text: list(_records(text)) for text in cases} == cases
    with pytest.raises(ValueError):
        list(_records('a,"open\nb'))


def test_half_characters_do_not_stop_a_job(spark):
    text = '{"a\\udc00":"./x\\ud800/y.txt","b":"./\\ud83d\\ude00"}'
    docs = spark.createDataFrame([(1, text), (2, '["/ok"]')], "doc_id long, content string")
    for kind in ("json", "tree"):
        assert {r["value"] for r in extract_tree(docs, kind).collect()} == {"./x\ufffd/y.txt", "./\U0001f600", "/ok"}
    checked = settings.validate_settings(spark.createDataFrame([(1, text)], "doc_id long, content string")).first()
    assert checked["errors"][0] == 'Unknown setting: "a\ufffd"'


def test_json_without_order_equals_the_ordered_walk(spark):
    from collections import Counter

    from pathloom.operators import variants
    from pathloom.operators.trees import extract_tree

    texts = [
        '{"b":"./x","a":{"c":["1","/y.z",[["http://h/p.q"]]],"d":"q"},"b":"./zz","n":null,"e":[],"":"./empty","x.y":"../k"}', "bad", '"./root.x"', None, " \n", "[NaN]", '["./a.bc"] x',
        '{"a":"./ab"} // c', "['./ab.cd']", '["./ab.cd",]', '{"10":"./a.bcd","9":"./b.bcd"}', "[1e400, \"./big\"]", '"./a.bc","end":1', '"./a.bc"} x', '"./a.bc"],["./b.cd"', '{"k":"/half\\ud800.ab"}',
        '{"k":"/pair\\ud83d\\ude00.ab"}', '{"k":"/back\\\\ud800.ab"}', '{"k":"/low\\udc00x.ab"}', '[01, "./ab.cd"]', '\ufeff["./ab.cd"]', "[" * 60 + '"./deep"' + "]" * 60, '["tab\there/ab.cd"]', '"C:\\\\dir\\\\f.txt"',
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").withColumn("value", F.lit(1)).withColumn("_at", F.lit("x"))
    want = Counter((r["doc_id"], r["value"], r["path_type"], r["context"]) for r in extract_tree(docs, "json").collect())
    found = variants.json_paths(docs.select("doc_id", "content"))
    assert Counter(map(tuple, found.collect())) == want and len(want) > 12
    assert "Python" not in variants.json_paths(docs)._jdf.queryExecution().executedPlan().toString()
    assert variants.json_paths(docs.filter("false")).count() == 0
