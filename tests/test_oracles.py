"""Every query against its SQL oracle on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from cellweave.registry import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _sorted(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = _sorted(tuple(row[c] for c in cols) for row in df.collect())
    cur = duck.execute(ORACLES[name])
    names, types = [c[0] for c in cur.description], [str(c[1]) for c in cur.description]
    assert sorted(names) == cols
    want = _sorted(tuple(row[names.index(c)] for c in cols) for row in cur.fetchall())
    assert got == want
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == dict(zip(names, types))
    assert not any(isinstance(x, float) and math.isnan(x) for row in got for x in row)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["sort_value_year", "sort_period_area", "sort_area_desc", "unique_values", "head_rows"])
def test_sorted_queries_keep_the_order(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    assert [tuple(r) for r in df.collect()] == duck.execute(ORACLES[name]).fetchall()
