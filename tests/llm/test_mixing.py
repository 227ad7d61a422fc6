"""Mixing against iterative proportional fitting in plain Python."""

from collections import Counter

import pytest

import fixtures
from cellweave.llm import mixing


def brute(cells, targets, rounds=200):
    """cells: {(a, b, c): tokens}; targets: [{value: share}]."""
    total = sum(cells.values())
    fitted = {k: n / total for k, n in cells.items()}
    for _ in range(rounds):
        for dim, target in enumerate(targets):
            now = Counter()
            for k, w in fitted.items():
                now[k[dim]] += w
            fitted = {k: w * (target[k[dim]] / now[k[dim]] if now[k[dim]] else 1) for k, w in fitted.items()}
    return fitted


def test_query_against_brute_force(spark):
    rows = mixing.op4_mixing(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in fixtures.documents(spark).collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    cells = Counter()
    for r in rows:
        assert r.tokens == len(texts[r.doc_id].split())
        cells[r.source, r.lang, r.topic] += r.tokens
    targets = []
    for dim, power in enumerate(mixing.TEMPERS.values()):
        n = Counter()
        for k, v in cells.items():
            n[k[dim]] += v
        scale = sum(v**power for v in n.values())
        targets.append({k: v**power / scale for k, v in n.items()})
    total = sum(cells.values())
    fitted = brute(cells, targets)
    for r in rows:
        cell = (r.source, r.lang, r.topic)
        assert r.weight == pytest.approx(fitted[cell] * total / cells[cell], rel=1e-3)
    assert sum(r.tokens * r.probability for r in rows) == pytest.approx(mixing.KEEP * total, rel=1e-3)
    rate = {round(r.probability / r.weight, 6) for r in rows if r.probability < 1}
    assert len(rate) <= 2  # one rate for all, up to rounding
    again = mixing.op4_mixing(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows if r.sampled} == {r.doc_id for r in again if r.sampled}


def test_given_targets_and_values_without_one(spark):
    rows = [(i, "word " * 10, "a" if i % 3 else "b", "x" if i % 2 else "y") for i in range(600)] + [(9999, "word " * 100, "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5), ("gone", 3.0)], "value string, share double")}
    got = mixing.mix(docs, targets=targets, keep=0.5).collect()
    total = sum(r.tokens for r in got)
    share = Counter()
    for r in got:
        share[r.source] += r.tokens * r.weight / total
    held = 100 / total
    assert share["c"] == pytest.approx(held)
    assert share["a"] == pytest.approx((1 - held) / 2) and share["b"] == pytest.approx((1 - held) / 2)


def test_many_cells_are_raked_in_spark(spark):
    rows = [(f"s{i % 7}", f"l{i % 3}", f"t{i * i % 5}", 1 + i * 37 % 101) for i in range(105)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    cells = cells.groupBy("source", "lang", "topic").sum("tokens").withColumnRenamed("sum(tokens)", "tokens")
    targets = {dim: mixing.tempered(cells, dim, power) for dim, power in mixing.TEMPERS.items()}
    here, there = ({tuple(r[:3]): r.fitted for r in mixing.rake(cells, targets, limit=n).collect()} for n in (1000, 0))
    assert here.keys() == there.keys() and all(here[k] == pytest.approx(there[k], rel=1e-9) for k in here)
    weighed = mixing.rake(cells, targets).withColumn("weight", mixing.F.col("fitted") * 1e4 / mixing.F.col("tokens"))
    assert mixing.calibrate(weighed) == pytest.approx(mixing.calibrate(weighed, limit=0))


def test_odd_rows(spark):
    odd = fixtures.odd(spark)
    got = mixing.mix(odd).collect()
    assert len(got) == len(fixtures.ROWS) and all(0 <= r.probability <= 1 and r.weight >= 0 for r in got)
    assert mixing.sample(odd).columns == odd.columns
    assert len(mixing.mix(odd, keep=1.0).filter("sampled").collect()) == len(fixtures.ROWS)
    assert mixing.mix(fixtures.none(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None), (2, "", "s", "en")], "doc_id long, text string, source string, lang string")
    assert mixing.mix(blank).count() == 2
