"""Registered queries against their twins on small tables with rows that the given ones lack."""

from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest

from pathloom.plans import detail_queries, scale_queries  # noqa: F401  register their queries
from pathloom.plans.queries import ORACLES, QUERIES


@pytest.fixture
def twin(spark, tmp_path):
    """Rows of a query and of its twin on the tables given as (name, schema, rows)."""

    def run(name, *tables):
        with duckdb.connect() as con:
            for table, schema, rows in tables:
                spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
                con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
            told = con.execute(ORACLES[name])
            columns = [d[0] for d in told.description]
            expected = sorted(map(repr, told.fetchall()))
        return sorted(repr(tuple(r)) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), expected

    return run


def test_numbers_of_large_keys(twin):
    got, expected = twin("format_numbers", ("events", "event_id long", [(k,) for k in (0, 1, 99, 40_000, 74_161, 97_777, 99_411, 99_999)]))
    assert got == expected


def test_sizes_beyond_64_bits(spark, tmp_path):
    """The twin's own product ends at 64 bits: the sizes against exact ones."""
    keys = (2_772_390, 2_772_391, 2_883_584, 5_999_999, 35_999_999)
    spark.createDataFrame([(k,) for k in (None, *keys)], "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    exact = {k: Decimal(k * k * 2 * (k % 7 * 100_000 + 1) + 1) / 1024**4 for k in keys}
    expected = {k: f"{v.quantize(Decimal('.01'), ROUND_HALF_UP):f}".rstrip("0").rstrip(".") + " TB" for k, v in exact.items()}
    got = {r["event_id"]: r for r in QUERIES["format_numbers"](spark, str(tmp_path)).collect()}
    assert {k: r["bytes"] for k, r in got.items()} == expected | {None: None}
    assert (got[35_999_999]["slow"], got[35_999_999]["number"]) == ("360.0M paths/s", "36,035,998,999")


def test_text_sink_of_equal_and_missing_addresses(twin):
    pages = [(1, "http://h/x"), (2, "http://h/x"), (3, "again http://h/x"), (4, None), (5, ""), (6, None), (7, "a\rb"), (8, "http://h/y")]
    got, expected = twin("text_sink", ("pages", "page_id long, url string", pages))
    assert got == expected and len(got) == 16


def test_workspace_folders_of_large_keys(twin):
    keys = [0, 1, 2999, 3000, 5999, 6000, 6001, 6003, 900_000_000]
    customers = ("customer", "c_custkey long", [(k,) for k in keys])
    got, expected = twin("workspace_folder_many", customers, ("orders", "o_orderkey long, o_custkey long", [(10 * k, k) for k in [*keys, 6006]]))
    assert got == expected and len(got) == len(keys)


def test_warnings_of_very_many_small_rows(spark, tmp_path):
    """One file of keys is dealt over tasks before keys become texts, and a text meets each pattern once."""
    spark.range(3, 40).toDF("p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["safety_warnings"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and plan.count("regexp_extract_all(") <= 8  # seven patterns and the quoted parts


def test_json_is_parsed_once_and_after_keys_are_dealt(spark, tmp_path, monkeypatch):
    from pathloom.operators import variants

    seen = []
    settle = variants.settled
    monkeypatch.setattr(variants, "settled", lambda rows: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or settle(rows))
    events = [(k,) for k in range(5)]
    spark.createDataFrame(events, "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = {tuple(r) for r in QUERIES["json_any_order"](spark, str(tmp_path)).select("doc_id", "value").collect()}
    assert found == {(k, v.format(k)) for k in range(5) for v in ("one{}.txt", "/two{}", "./x{}", "../last{}")}
    above, below = seen[0].split("RepartitionByExpression")
    assert above.lower().count("parse_json") + above.count("parseJson") == 1 and "json" not in below.lower()


def test_rounds_of_cycles_broadcast_nothing(spark, monkeypatch):
    from pathloom.operators import cycles

    plans, settle = [], cycles.settled
    monkeypatch.setattr(cycles, "settled", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or settle(rows))
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), (None, "a")], "src string, dst string")
    found = cycles.strong_components(edges)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, found.collect())) == [("a", "a", 2), ("b", "a", 2), ("c", "c", 1)]
    assert any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "Broadcast" in p]
