"""Files in pieces against whole files: numbered lines, paths of lines, and CSV records cut anywhere."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.operators.trees import found_in
from pathloom.sources import pieces
from pathloom.sources.documents import scan_files

SHAPES = [
    'a,b\n./x,/y.z\n', '"./a","b ""q"" c",/d\n\n  \n"",x\n', '"multi\nline",./after\n./next,"\n/in/quotes\n"\n', "x,./y\r\n\"a\r\nb\",/z\r\n", "./only", "",
    'a"b",./c\n"unclosed" x,./d\n', 'p,"open\nno end ./x', '"turned\nout" plain,./y\nz,./w\n', "mixed,./a\r\nplain,./b\n", "old,./a\rmac,./b", '﻿./bom,x\n./y,z\n',
    '"a\n\n\n./deep\n",./b,"\n\n",./c,"x\n",./d\n./e\n', '"a\n"",""\n",./b\n', ' "./sp" ,\t"/t"\t,./u \n',
]


@pytest.fixture
def split_bytes(spark):
    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def files(tmp_path, texts, ending):
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}{ending}").write_bytes(text.encode())
    return f"file://{tmp_path}"


def fields(rows):
    return Counter((r["value"], r["path_type"], r["line"], r["column"], r["context"], r["ordinal"], r["doc_id"]) for r in rows)


def test_lines_are_numbered_across_splits(spark, tmp_path, split_bytes):
    texts = ["".join(f"line {i} of {n}\n" for i in range(n * 40)) + "end" * (n % 2) for n in range(4)]
    where = files(tmp_path, texts, ".txt")
    split_bytes(97)
    lines = pieces.scan_lines(spark, where)
    assert lines.rdd.getNumPartitions() > 20
    got = Counter((r["uri"][-6:-4], r["line"], r["text"]) for r in lines.collect())
    assert got == Counter((f"f{n}", i, text) for n, t in enumerate(texts) for i, text in enumerate(t.removesuffix("\n").split("\n"), 1) if t)


def test_paths_of_lines_equal_those_of_whole_files(spark, tmp_path, split_bytes):
    from pathloom.plans.engine import extract_documents

    draw = random.Random(3)
    html = "".join(draw.choice(['<a href="./p%d">é😀<img src=\'/q%d.png\'>', "plain text", "", "<p data-src='x%d.y' srcset='a%d 1x, b 2x'>\r"]).replace("%d", str(i)) + "\n" for i in range(400))
    css = "".join(f"@import './s{i}.css';\n.a {{ background: url(img{i}.png) }}\n" for i in range(200))
    js = "".join(f"import x from './m{i}.js'; const y = require('../r{i}')\n" for i in range(150))
    for name, text in (("a.html", html), ("b.css", css), ("c.js", js), (".env.local", "A=./x\n#\nB='/y z'\n"), ("d.csv", "./not,here\n")):
        (tmp_path / name).write_bytes(text.encode())
    where = f"file://{tmp_path}"
    whole = fields(extract_documents(scan_files(spark, where).filter("uri not like '%.csv'")).paths.collect())
    for size in (211, 5000, 10**8):
        split_bytes(size)
        found = pieces.extract_lines(spark, where)
        assert fields(found.collect()) == whole
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 11, 16, 1000])
def test_csv_cut_anywhere_equals_whole_files(spark, tmp_path, split_bytes, size):
    where = files(tmp_path, SHAPES, ".csv")
    ids = {r["uri"].rsplit("/f", 1)[1]: r["doc_id"] for r in scan_files(spark, where).select("uri", "doc_id").collect()}
    want = Counter()
    for i, text in enumerate(SHAPES):
        for n, (value, line, column, context) in enumerate(found_in("csv", text.removeprefix("﻿"))[0]):
            want[value, line, column, context, n, ids[f"{i}.csv"]] += 1
    split_bytes(size)
    got = Counter((r["value"], r["line"], r["column"], r["context"], r["ordinal"], r["doc_id"]) for r in pieces.extract_csv_files(spark, where).collect())
    assert got == want


def test_states_of_lines_equal_the_whole_parser():
    draw = random.Random(7)
    for _ in range(4000):
        text = "".join(draw.choice(['"', '""', ",", "\n", "./a", " ", "x", "\t", "/b.c", '",', ',"', '"\n']) for _ in range(draw.randint(0, 25)))
        lines, reader, got = text.split("\n"), pieces.Reader(), []
        if text.endswith("\n"):
            lines = lines[:-1]
        for line in lines:
            got += list(reader.line(line))
        found, failed = found_in("csv", text)
        if reader.void or reader.open:
            continue
        assert failed is None and got == found, text


def test_random_csv_in_pieces(spark, tmp_path, split_bytes):
    draw = random.Random(9)
    texts = ["".join(draw.choice(["./a%d", "/b/c", '"q%d"', '"m\n./n"', '"\n./p%d\n"', "", " ", "x.y"]).replace("%d", str(i)) + draw.choice([",", ",", "\n"]) for i in range(150)) for _ in range(6)]
    where = files(tmp_path, texts, ".csv")
    want = Counter(f[:4] for t in texts for f in found_in("csv", t)[0])
    for size in (13, 101):
        split_bytes(size)
        got = Counter((r["value"], r["line"], r["column"], r["context"]) for r in pieces.extract_csv_files(spark, where).collect())
        assert got == want
    ordinals = pieces.extract_csv_files(spark, where).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ordinal").alias("d"), F.max("ordinal").alias("m"))
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in ordinals.collect())
