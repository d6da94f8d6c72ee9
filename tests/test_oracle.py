"""Each registered query against its SQL."""

import math
import os

import duckdb
import pytest

from spanwise import catalog

SF = os.environ.get("SPANWISE_SF", "/root/testdata/sf0.001")
TABLES = ["orders", "lineitem", "events", "customer", "supplier", "nation", "region", "part"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 5) + 0.0
        return x if x is None or isinstance(x, (int, str, bool)) else str(x)

    return sorted((tuple(cell(x) for x in r) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    want = db.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = plain(got.select(*columns).collect())
    assert rows == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert rows
