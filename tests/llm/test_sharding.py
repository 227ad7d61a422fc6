"""Sharding: near equal sizes, whole groups, gapless slots, odd rows."""

import zlib

import numpy as np
import pytest

import fixtures
from cellweave.llm import sharding


def loads(rows, key="shard"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r["size"])
    return out


def test_pack_takes_the_highest_dot_product():
    items = np.array([[10.0, 1, 1], [1, 10, 1], [5, 5, 1], [5, 5, 1]])
    got = sharding.pack(items, 2, (1, 1, 1))
    unit = items / (items.sum(axis=0) / 2)
    residual = np.ones((2, 3))
    for i in np.lexsort((np.arange(4), -unit.sum(axis=1))):
        assert got[i] == int(np.argmax(residual @ unit[i]))
        residual[got[i]] -= unit[i]


def test_query(spark):
    got = sharding.op2_sharding(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in fixtures.documents(spark, "sf0.01").collect()}
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    by = loads(got)
    assert sorted(by) == list(range(24))
    sums = [sum(v) for v in by.values()]
    assert max(sums) < 1.03 * np.mean(sums) and min(sums) > 0.97 * np.mean(sums)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    shards = {}
    for r in got:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_bundles_and_a_group_no_shard_can_hold(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUNDLES", 64)
    rows = [(i, "copy " * 40) for i in range(3000)]
    rows += [(10_000 + i, f"own text {i} " * (1 + i % 30)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(docs, 8).collect()
    sums = [sum(v) for v in loads(got).values()]
    assert len(got) == len(rows) and len(sums) == 8
    assert max(sums) < 1.03 * np.mean(sums) and min(sums) > 0.97 * np.mean(sums)


@pytest.mark.parametrize("parts", [5_000, 2])
def test_odd_rows(spark, monkeypatch, parts):
    monkeypatch.setattr(sharding, "NUMBERED", parts)
    got = sharding.shard_documents(fixtures.odd(spark).withColumn("slot", sharding.F.lit("x")), 3).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted(
        (i or -1, len((t or "").encode()) + 8) for i, t, *_ in fixtures.ROWS
    )
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(fixtures.none(spark), 3).count() == 0
