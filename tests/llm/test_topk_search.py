"""Top-k search against scoring all pairs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import topk_search
from cellweave.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, is_query, k):
    whole = []
    for i, v in rows:
        if v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        whole.append((i, [math.floor(256 * float(np.float32(c))) for c in v]))
    out = []
    for a, (i, q) in enumerate(whole):
        if i is None or not is_query(i):
            continue
        found = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(whole) if a != b]
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def search(spark, rows, k=5, **more):
    data = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]
    df = spark.createDataFrame(data, SCHEMA).withColumn("score", F.lit("x")).withColumn("q", F.lit(1)).repartition(4)
    got = topk_search.search(df, "vec_id", "embedding", F.pmod("vec_id", F.lit(10)) == 0, k, **more)
    return sorted([tuple(r) for r in got.collect()], key=repr)


@pytest.mark.parametrize("block", [3, 2048])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    common = [0.5] * 8
    rows += [(1000 + i, common) for i in range(60)]  # ties, also at the edge, and equal queries
    rows += [(30, common), (30, common), (40, rows[40][1]), (None, common), (None, rows[7][1])]
    rows += [(2000, None), (2010, [float("nan")] * 8), (2020, [None] + [1.0] * 7), (2030, [float("inf")] * 8)]
    rows += [(2040, [2.0, 3.0]), (2050, []), (2060, [0.0] * 8)]
    assert search(spark, rows, block_rows=block) == brute(rows, lambda i: i % 10 == 0, 5)


def test_few_rows(spark):
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0])]) == []
    rows = [(0, [1.0]), (1, [-1.0]), (10, [2.0])]
    assert search(spark, rows) == brute(rows, lambda i: i % 10 == 0, 5)


def test_large_scores_are_exact(spark):
    rows = [(i, [3.0e6 + i, 7.0e6 - 3 * i, 1.0]) for i in range(30)]
    assert search(spark, rows) == brute(rows, lambda i: i % 10 == 0, 5)


def test_query_equals_sql(spark):
    cols = ["query_id", "rank", "vec_id", "score"]
    got = QUERIES["op12_topk_search"](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES['op12_topk_search']})").fetchall()
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(want) and len(want) == 50
