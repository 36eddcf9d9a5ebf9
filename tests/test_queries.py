"""Every registered path query against its SQL twin, on the smallest tables."""

from pathlib import Path

import pytest

from pathloom.plans import detail_queries, scale_queries  # noqa: F401  register their queries
from pathloom.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for table in DATA.iterdir():
        files = table if table.is_file() else table / "*.parquet"
        con.execute(f"CREATE VIEW {table.name.removesuffix('.parquet')} AS SELECT * FROM '{files}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    found = QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    got = sorted(repr([r[c] for c in columns]) for r in found.collect())
    told = duck.execute(ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    assert got == sorted(repr([r[names.index(c)] for c in columns]) for r in told.fetchall())


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
