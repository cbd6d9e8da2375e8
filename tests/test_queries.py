"""Every registered query of the core against its DuckDB twin."""

import glob
import os

import duckdb
import pytest

from sievework.plans.all import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if isinstance(v, float):
            return "null" if v != v else f"{v:.6g}"
        if isinstance(v, (list, tuple)):
            return str([plain(x) for x in v])
        return "null" if v is None else str(v)

    return sorted(columns), sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert got == rows(rel.columns, rel.fetchall())
