"""Every registered query of the subpackage against its SQL, on the smallest driver tables."""

import math
import os

import pytest

import __spark_entry__ as driver
from claimspark.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not found")
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(value):
    return value if not isinstance(value, float) else "nan" if math.isnan(value) else round(value, 6)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    oracle = con.sql(ORACLES[name])
    names = list(oracle.columns)
    assert sorted(names) == columns
    kinds = dict(zip(names, map(str, oracle.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in oracle.fetchall()), key=repr)
    assert got and got == want


def test_registered():
    assert set(ORACLES) <= set(QUERIES) <= set(driver.queries())
    assert "pipeline" in driver.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
