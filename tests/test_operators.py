"""Operators on tables: order, ties, nulls, empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from pathloom.operators import admission, metrics, post, profile, resolve, settings, validate
from pathloom.sources import sinks
from pathloom.sources.documents import scan_files
from pathloom.sql import register

LINES = ["./b", " ./a ", "", "./b", "./B", "./aa"]


@pytest.fixture
def values(spark):
    docs = spark.createDataFrame([(1, "\n".join(LINES))], "doc_id long, content string")
    return post.trimmed_lines(docs)


def ordered(df, *keys):
    return [r["value"] for r in df.orderBy(*keys).collect()]


def test_dedupe(spark, values):
    assert ordered(post.dedupe_first(values), "ordinal") == ["./b", "./a", "./B", "./aa"]
    docs = spark.createDataFrame([(1, "\n".join(LINES))], "doc_id long, content string")
    assert tuple(post.removed_counts(docs).first())[1:] == (6, 4, 2)


@pytest.mark.parametrize("mode,expected", [
    ("length-asc", ["./b", "./a", "./b", "./B", "./aa"]), ("length-desc", ["./aa", "./b", "./a", "./b", "./B"]),
    ("alpha-asc", ["./a", "./aa", "./b", "./b", "./B"]), ("alpha-desc", ["./B", "./b", "./b", "./aa", "./a"]),
])
def test_sorts(values, mode, expected):
    assert ordered(post.ranked(values, mode), "rank") == expected
    assert [r["value"] for r in post.sort_values(values, mode).collect()] == expected


def test_profile(spark):
    rows = [(i, v) for i, v in enumerate(["/a/b.js", "/c/d.js", "/e/f_g.TS", "/x/y.js", "/z/w.js"])]
    found = profile.patterns(spark.createDataFrame([(1, *r) for r in rows], "doc_id long, ordinal int, value string"))
    top = found.orderBy(F.desc("count")).first()
    assert (top["pattern"], top["count"], top["percentage"], top["examples"]) == ("/X/X.XX", 4, 80.0, ["/a/b.js", "/c/d.js", "/x/y.js"])
    assert {r["extension"]: r["count"] for r in profile.extensions(spark.createDataFrame(rows, "ordinal int, value string")).collect()} == {"js": 4, "ts": 1}


def test_containing_folder_ends_at_separators(spark):
    folders = spark.createDataFrame([(i, "f", p, "file") for i, p in enumerate(["/m", "/m/p", "/m/p1"])], "folder_index int, name string, fs_path string, scheme string")
    paths = spark.createDataFrame([("/m/p12/a",), ("/m/p1",), ("/x",), (None,)], "value string")
    expected = {"/m/p12/a": "/m", "/m/p1": "/m/p1", "/x": None, None: None}
    assert {r["value"]: r["folder"] for r in resolve.containing_folder(paths, folders).collect()} == expected
    many = resolve._FEW_FOLDERS
    resolve._FEW_FOLDERS = 2
    try:
        assert {r["value"]: r["folder"] for r in resolve.containing_folder(paths, folders).collect()} == expected
    finally:
        resolve._FEW_FOLDERS = many
    assert resolve.containing_folder(paths, folders.limit(0)).filter("folder is not null").count() == 0


def test_resolve(spark):
    paths = spark.createDataFrame([("./a/../b", "/ws"), ("https://h//x", "/ws"), ("", "/ws"), ("/l", "/ws"), ("c", None)], "value string, folder string")
    entries = spark.createDataFrame([("/l", "/real")], "path string, real_path string")
    got = {r["value"]: r["resolved"] for r in resolve.resolve_paths(paths, folder="folder", entries=entries).collect()}
    assert got == {"./a/../b": "/ws/b", "https://h//x": "https://h//x", "": "", "/l": "/real", "c": "c"}
    odd = resolve.resolve_paths(paths, folder="folder", compat_urls=True).filter("value like 'https%'").first()
    assert odd["resolved"] == "/ws/https:/h/x"


def test_validate(spark):
    paths = spark.createDataFrame([("a/b",), ("a/c",), ("https://e.com",), ("C:\\x",), ("../x",), (None,)], "value string")
    entries = spark.createDataFrame([("a/b",)], "path string")
    got = {r["value"]: (r["status"], r["error"]) for r in validate.validate_paths(paths, entries).collect()}
    assert got["a/b"] == ("valid", None) and got["a/c"] == ("invalid", "File not found: a/c")
    assert all(got[v][0] == "invalid" for v in ("https://e.com", "C:\\x", "../x", None))
    assert tuple(validate.rollup(validate.validate_paths(paths)).first()) == (2, 4, 0, 0)


def test_admission(spark):
    docs = spark.createDataFrame([("x" * 20,), ("a\nb\nc",), (None,), ("😀😀😀",)], "content string")
    got = [r["a"] for r in docs.select(admission.admission("content", max_units=6, max_lines=2).alias("a")).collect()]
    assert [r["proceed"] for r in got] == [False, True, True, True] and got[1]["warnings"] == ["Large file detected: 3 lines (threshold: 2)"]
    assert admission.admit(docs, max_units=5).count() == 2


@pytest.mark.parametrize("content,valid,errors", [
    ('{"dedupeEnabled": true}', True, []), ("3", False, ["Settings must be a JSON object"]), ("[]", False, ["Settings must be a plain JSON object"]),
    ('{"safety.manyDocumentsThreshold": 0}', False, ['Setting "safety.manyDocumentsThreshold": Value 0 is below minimum 1']),
    ('{"__proto__": 1, "x": 2}', False, ['Dangerous setting key rejected: "__proto__"', 'Unknown setting: "x"']),
    ('{"keyboard.extractShortcut": "' + "k" * 501 + '"}', False, ['Setting "keyboard.extractShortcut": String value too long (max 500 characters)']),
    ("{" + ",".join(f'"k{i}":1' for i in range(101)) + "}", False, ["Settings file contains too many keys (max 100)"]),
    ('{"telemetryEnabled": null}', False, ['Setting "telemetryEnabled": Expected boolean, got object']),
])
def test_settings(content, valid, errors):
    assert settings.check_settings(json.loads(content))[:2] == (valid, errors)


def test_settings_round_trip():
    exported = settings.export_settings(settings.EngineConfig(dedupe_enabled=True))
    config, errors = settings.import_settings(exported)
    assert not errors and config == settings.EngineConfig(dedupe_enabled=True)
    assert settings.import_settings("")[1] == ["Settings file is empty"]
    assert settings.configuration({"safety.fileSizeWarnBytes": 5}).safety_file_size_warn_bytes == 1000


def test_thresholds(spark):
    rows = spark.createDataFrame([(11_000, 0, 0, 5000)], "duration long, memory_usage long, cpu_usage long, throughput long")
    out = metrics.check_thresholds(rows).first()
    assert not out["passed"] and out["errors"] == ["Severe performance degradation: 11.00s"]
    assert metrics.report(rows).first()["operations"] == 1


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.css").write_text("a{b:url(./x)}\nc{d:url(/y)}")
    docs = scan_files(spark, str(tmp_path / "in"))
    from pathloom.plans.engine import extract_documents

    paths = extract_documents(docs).paths
    sinks.write_text(paths, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["./x", "/y"]
    assert sinks.joined(paths).first()["text"] == "./x\n/y"
    sinks.write_rows(paths, str(tmp_path / "rows"), "csv")


def test_stream_equals_batch(spark, tmp_path):
    from pathloom.operators.extract import extract
    from pathloom.streaming.extract import stream_files, stream_paths

    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.html").write_text(f'<a href="./{i}"><img srcset="a.png 1x, b{i}.png 2x">')
    stream = stream_paths(stream_files(spark, str(tmp_path / "in"), max_files=2))
    run = stream.writeStream.format("memory").queryName("paths_seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = extract(scan_files(spark, str(tmp_path / "in")), "html")
    assert sorted(r["value"] for r in spark.table("paths_seen").collect()) == sorted(r["value"] for r in batch.collect()) and batch.count() == 15


def test_sql_functions(spark):
    register(spark)
    got = spark.sql("""SELECT t.value FROM VALUES ('["./a", "x.html"]') AS d(c), LATERAL extract_json(d.c) t ORDER BY t.ordinal""").collect()
    assert [r[0] for r in got] == ["./a", "x.html"] or [r[0] for r in got] == ["./a"]
    row = spark.sql(r"SELECT path_normalize('a\\\\b//c/'), path_is_absolute('C:\\\\x'), path_depth('/a/b'), path_pattern('a1')").first()
    assert tuple(row) == ("a/b/c", True, 2, "XX")


def test_every_sql_scalar_equals_its_expression(spark):
    from pathloom.sql import SCALARS

    register(spark)
    texts = ["/a//b_c/D.tar.gz/", "C:\\x\\CON", "./a b", "https://h/x", "..\\y", "", "token=q /Users/me/x", ".env", None]
    views = {"STRING": texts, "BIGINT": [0, 5000, 2**33 + 1, None], "DOUBLE": [0.125, 0.3, None]}
    for kind, values in views.items():
        spark.createDataFrame([(v,) for v in values], f"p {kind}").createOrReplaceTempView(f"some_{kind}")
    for name, (kind, function) in SCALARS.items():
        by_sql = [r[0] for r in spark.sql(f"SELECT {name}(p) FROM some_{kind}").collect()]
        assert by_sql == [r[0] for r in spark.table(f"some_{kind}").select(function("p")).collect()], name


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["path_type", "count"]


def test_recent_lines(spark):
    rows = spark.createDataFrame([(i, 1000 * i, 1024, 10) for i in range(15)], "t int, duration long, memory_usage long, throughput long")
    got = [r["line"] for r in metrics.recent_lines(rows, "t", 3).orderBy("place").collect()]
    assert got == [f"{k}. Duration: {s}.00s, Memory: 1 KB, Throughput: 10 items/s" for k, s in ((1, 12), (2, 13), (3, 14))]


def test_links_of_links_on_folders_and_loops(spark):
    from pathloom.operators import links

    chain = [(f"/c/n{i}", f"n{i + 1}") for i in range(12)]
    table = [
        *chain, ("/w/site", "/c/n0"), ("/c/n12/lib", "../../opt/lib"), ("/a", "/b"), ("/b", "/a"), ("/self", "/self/x"), ("/dead", None), ("/to-dead", "dead/x"), ("/root", "/"),
        ("/two", "/x"), ("/two", "/y"), (None, "/z"), ("relative", "/z"), ("/w//odd/", "\\c\\n11"), ("/opt/lib/v", "/opt/v2"),
    ]
    inventory = spark.createDataFrame(table, "path string, target string").withColumn("at", F.lit(1)).withColumn("real", F.lit("x"))
    closed = {r["path"]: (r["real"], r["follows"]) for r in links.close_links(inventory).collect()}
    assert closed["/c/n0"] == ("/c/n12", 12) and closed["/w/site"] == ("/c/n12", 13) and closed["/w/odd"] == ("/c/n12", 2)
    assert closed["/a"] == (None, 41) and closed["/self"] == (None, 41) and closed["/dead"][0] is None and closed["/to-dead"][0] is None
    assert closed["/c/n12/lib"] == ("/opt/lib", 1) and closed["/two"] == ("/x", 1) and len(closed) == 23
    values = ["/w/site/lib/v/z.js", "/w/site", "/w/sites", "/a/x", "/dead", "/root/etc", "/root", "/plain//p/", "./up", None, "", "/c/n12/x", "/c/n12/x"]
    paths = spark.createDataFrame(list(enumerate(values)), "i int, value string").withColumn("follows_", F.lit(0)).withColumn("_key", F.lit(1))
    got = {r["i"]: (r["resolved"], r["follows"], r["fallback"]) for r in links.canonical_links(paths, inventory).collect()}
    assert got[0] == ("/opt/v2/z.js", 15, False) and got[1] == ("/c/n12", 13, False) and got[2] == ("/w/sites", 0, False)
    assert got[3] == ("/a/x", 41, True) and got[4][::2] == ("/dead", True) and got[5] == ("/etc", 1, False) and got[6] == ("/", 1, False)
    assert got[7] == ("/plain/p", 0, False) and got[8] == ("./up", 0, False) and got[9] == (None, 0, False) and got[11] == got[12] == ("/c/n12/x", 0, False)
    assert links.close_links(inventory.filter("false")).count() == 0 and links.canonical_links(paths, inventory.filter("false")).filter("fallback").count() == 0


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    from pathloom.operators import links

    rounds = []
    step = links._step
    monkeypatch.setattr(links, "_step", lambda *a: rounds.append(1) or step(*a))
    for length, most in ((4, 4), (32, 7)):
        inventory = spark.createDataFrame([(f"/n{i}", f"n{i + 1}") for i in range(length)], "path string, target string")
        rounds.clear()
        assert {r["real"] for r in links.close_links(inventory).collect()} == {f"/n{length}"} and len(rounds) <= most


def test_canonical_follows_links_on_folders(spark):
    from pathloom.operators.resolve import canonical

    folders = spark.createDataFrame([(0, "w", "/w", "file")], "folder_index int, name string, fs_path string, scheme string")
    inventory = spark.createDataFrame([("/w/lib", "../shared/lib"), ("/w/loop", "loop"), ("/shared/lib/x", "y")], "path string, real_path string")
    paths = spark.createDataFrame([(0, "./lib/x/a.js"), (1, "loop/a.js"), (2, "https://x/lib"), (3, "plain.js")], "i int, value string")
    got = {r["i"]: (r["resolved"], r["fallback"]) for r in canonical(paths, folders=folders, links=inventory, parents=True).collect()}
    assert got == {0: ("/shared/lib/y/a.js", False), 1: ("loop/a.js", True), 2: ("https://x/lib", False), 3: ("/w/plain.js", False)}


def test_dedupe_and_sorts_stay_in_their_rows(spark):
    from pathloom.operators import post
    from pathloom.plans.engine import extract_documents

    docs = spark.createDataFrame([(1, "html", '<a href="./b"><a href="./a"><a href="./b"><a href="./B"><a href="./aa">'), (2, "html", None)], "doc_id long, language_id string, content string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = extract_documents(docs, dedupe=True)
    assert "Exchange" not in plan(found.paths) and [(r["ordinal"], r["value"]) for r in found.paths.collect()] == [(0, "./b"), (1, "./a"), (3, "./B"), (4, "./aa")]
    every = extract_documents(docs).documents
    for mode, want in {"alpha-asc": [1, 4, 0, 2, 3], "alpha-desc": [3, 0, 2, 4, 1], "length-asc": [0, 1, 2, 3, 4], "length-desc": [4, 0, 1, 2, 3]}.items():
        ranked = every.select("doc_id", F.explode(post.ranked_in_array("paths", mode)).alias("x")).select("x.*")
        assert "Exchange" not in plan(ranked) and [r["ordinal"] for r in ranked.orderBy("rank").collect()] == want


def test_places_of_documents_travel_with_their_paths(spark):
    from pathloom.operators.settings import EngineConfig
    from pathloom.plans.engine import extract_with

    docs = spark.createDataFrame([(1, "html", '<a href="x.js">', "/w/a"), (1, "html", '<a href="y.js">', "/w/b")], "doc_id long, language_id string, content string, uri string")
    folders = spark.createDataFrame([(0, "a", "/w/a", "file"), (1, "b", "/w/b", "file")], "folder_index int, name string, fs_path string, scheme string")
    rows = extract_with(docs, EngineConfig(), folders=folders, sources="uri")[1]
    assert sorted(r["resolved"] for r in rows.collect()) == ["/w/a/x.js", "/w/b/y.js"]  # rows that share an id are not multiplied


def test_a_slow_run_ends_at_its_limit_and_leaves_nothing(spark, tmp_path):
    import threading
    import time

    from pathloom.operators.runs import Cancelled, Token, within

    def sleepy(frames):
        import time

        for frame in frames:
            time.sleep(60)
            yield frame

    slow = spark.range(4, numPartitions=4).mapInPandas(sleepy, "id long")
    path, other = f"file://{tmp_path}/out", []
    beside = threading.Thread(target=lambda: other.append(spark.range(10).count()))
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        beside.start()
        within(spark, lambda: slow.write.parquet(path), seconds=2, writes=path)
    assert time.monotonic() - began < 12 and not (tmp_path / "out").exists()
    beside.join()
    assert other == [10]
    token = Token()
    threading.Timer(1.0, token.cancel).start()
    with pytest.raises(Cancelled):
        within(spark, lambda: slow.write.parquet(path), token=token, writes=path)
    with pytest.raises(Cancelled):
        within(spark, lambda: 1, token=token)
    assert within(spark, lambda: spark.range(5).count(), seconds=60) == 5
    with pytest.raises(ZeroDivisionError):
        within(spark, lambda: 1 / 0, seconds=60)


def test_runs_are_measured_while_they_write(spark, tmp_path):
    from pathloom.operators.metrics import Thresholds
    from pathloom.operators.runs import measured
    from pathloom.plans.engine import extract_documents

    docs = spark.createDataFrame([(1, "html", '<a href="./b"><a href="./a">'), (2, "yaml", "x"), (3, "json", '["./a"]')], "doc_id long, language_id string, content string")
    run = measured(extract_documents(docs).documents, lambda rows: rows.write.parquet(str(tmp_path / "out")))
    assert (run.documents, run.paths, run.failed, run.bytes) == (3, 3, 1, 0) and run.duration > 0
    row = run.checked(spark, Thresholds(max_duration=0, min_throughput=1e12)).first()
    assert {w["type"] for w in row["warnings"]} == {"duration", "throughput"} and not row["passed"]
    assert run.checked(spark, Thresholds(max_duration=1e9, min_throughput=0)).first()["passed"]
    none = measured(extract_documents(docs.filter("false")).documents, lambda rows: rows.write.parquet(str(tmp_path / "none")))
    assert (none.documents, none.paths, none.failed) == (0, 0, 0)


def test_strong_components_equal_brute_force(spark):
    import random

    from pathloom.operators.cycles import strong_components

    draw = random.Random(4)
    edges = [(draw.randint(0, 39), draw.randint(0, 39)) for _ in range(45)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 200), (201, 202), (None, 3), (4, None), (100, 300), (300, 301)]
    edges += edges[:5]
    reach = {a: {a} for e in edges for a in e if a is not None}
    for _ in range(60):
        for a, b in edges:
            if a is not None and b is not None:
                for seen in reach.values():
                    if a in seen:
                        seen.add(b)
    same = {a: sorted(b for b in reach if b in reach[a] and a in reach[b]) for a in reach}
    want = {(a, s[0], len(s)) for a, s in same.items() if len(s) > 1 or (a, a) in edges}
    table = spark.createDataFrame(edges, "src long, dst long").withColumn("colour", F.lit(1))
    assert {tuple(r) for r in strong_components(table).collect()} == want and len(want) > 12
    assert strong_components(table.filter("src >= 200")).collect() == [(200, 200, 1)]
    assert strong_components(table.filter("false")).count() == 0


def test_patterns_work_their_input_out_once(spark, tmp_path):
    from pathloom.operators.extract import extract

    docs = spark.createDataFrame([(i, f'<a href="./a{i % 3}b"><a href="/x">') for i in range(40)], "doc_id long, content string").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    found = profile.patterns(extract(spark.read.parquet(str(tmp_path / "docs")), "html"))
    rows = {r["pattern"]: (r["count"], r["percentage"], r["examples"]) for r in found.collect()}
    assert rows == {"./XXX": (40, 50.0, ["./a0b", "./a1b", "./a2b"]), "/X": (40, 50.0, ["/x", "/x", "/x"])}
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1 or "ReusedExchange" in final
    by = profile.patterns(extract(docs, "html"), by=("doc_id",)).filter("doc_id = 4").collect()
    assert sorted((r["pattern"], r["count"], r["percentage"]) for r in by) == [("./XXX", 1, 50.0), ("/X", 1, 50.0)]
