"""Whitening against numpy on the exact whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import whitening
from cellweave.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, k=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    centred = n * x - sums
    cov = np.array(centred.T @ centred, dtype=float) / n**3
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    white = (np.array(centred, float) / n) @ axes[:, order] / np.sqrt(values[order])
    return n, (centred**2).sum(axis=1), white, values[order] / values.sum()


def frame(spark, vectors, extra=()):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows + list(extra), SCHEMA)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 40]
    good[10:40] = good[9]  # repeated rows
    bad = [(900, None), (901, [1.0, None, 0, 0, 0, 0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [1.0])]
    bad = [(i, v and [None if c is None else float(c) for c in v]) for i, v in bad]
    df = frame(spark, good.tolist(), bad).withColumn("key", F.lit(1)).withColumn("n", F.lit("x")).repartition(5)
    got = {r["vec_id"]: r for r in whitening.whiten(df, "vec_id", "embedding").collect()}
    n, far, white, share = brute(good.tolist())
    assert sorted(got) == list(range(300)) and {r["n"] for r in got.values()} == {n}
    assert [int(got[i]["deviation"]) for i in range(300)] == far.tolist()
    mine = np.array([got[i]["whitened"] for i in range(300)])
    signs = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine * signs, white, rtol=1e-9, atol=1e-9)
    assert np.allclose(got[0]["explained"], share, rtol=1e-9)
    assert got[0]["identity_error"] < 1e-9
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(6)).max() == pytest.approx(got[0]["identity_error"], abs=1e-12)


def test_products_are_exact():
    rng = random.Random(1)
    y = np.array([[rng.randrange(1 << b) if b else 0 for b in (50, 3, 0, 33)] for _ in range(201)], np.int64)
    bits = [50, 3, 0, 33]
    limbs = np.zeros((4, 4, 4), np.int64)
    for part in (y[:130], y[130:]):
        whitening.add_products(whitening.bit_planes(part, bits), bits, limbs)
    exact = y.astype(object)
    for i in range(4):
        for j in range(i, 4):
            total = sum(int(limbs[k, i, j]) << (30 * k) for k in range(4))
            assert total == sum(exact[:, i] * exact[:, j])


def test_large_and_negative_entries(spark):
    vectors = [[1e9, -3.0], [-1e9, 5.5], [250.0, -700.25], [0.0, 1e6]]
    n, far, white, _ = brute(vectors)
    got = sorted(whitening.whiten(frame(spark, vectors), "vec_id", "embedding").collect(), key=lambda r: r["vec_id"])
    assert [int(r["deviation"]) for r in got] == far.tolist()
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [[1e30, 1.0], [0.0, 1.0]]), "vec_id", "embedding").collect()


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten(frame(spark, []), "vec_id", "embedding").count() == 0
    assert whitening.whiten(frame(spark, [None, []]), "vec_id", "embedding").count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 4), "vec_id", "embedding").count() == 0
    one = whitening.whiten(frame(spark, [[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]]), "vec_id", "embedding").collect()
    assert [len(r["whitened"]) for r in one] == [1, 1, 1]  # the second component has no variance


def test_query(spark):
    df = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double",
    }
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    n, far, white, share = brute([r["embedding"] for r in rows])
    got = df.orderBy("component", "vec_id").collect()
    assert len(got) == 8 * n and {r["deviation"] for r in got} == set(far.tolist())
    for k in range(8):
        mine = np.array([r["whitened"] for r in got[k * n : (k + 1) * n]])
        assert np.allclose(np.abs(mine), np.abs(white[:, k]), rtol=1e-7, atol=1e-9)
        assert abs(got[k * n]["explained"] / share[k] - 1) < 1e-9
    assert got[0]["identity_error"] < 1e-4
