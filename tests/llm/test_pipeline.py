"""The pipeline: each stage against brute force on its own input, and odd rows through all of it."""

import pytest

import corpus_pipeline
import fixtures
from cellweave.llm import mixing
from test_quality_rules import brute as measures
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the output of each stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), fixtures.documents(spark), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules",
        "SimHash near-dedup",
        "benchmark decontamination",
        "mixing sources to target weights",
        "sharding",
    ]


def test_all_but_the_last_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns
    assert stages[-1][1].columns == [*stages[-1][0].columns, "size", "shard", "slot"]


def test_quality(stages):
    before, after = stages[0]
    kept = set(ids(after))
    assert kept and kept < set(ids(before))
    for r in before.collect():
        n_words, *_, repeated = measures(r.text)
        if n_words < 20 or 100 * repeated > 30 * n_words:
            assert r.doc_id not in kept


def test_near_duplicates(stages):
    before, after = stages[1]
    fps = {r.doc_id: brute_fingerprint(r.text) for r in before.collect()}
    names = brute_components(set(fps.values()), 2)
    first = {}
    for i, fp in fps.items():
        first[names[fp]] = min(i, first.get(names[fp], i))
    assert ids(after) == sorted(first.values())


def test_decontamination(spark, stages):
    before, after = stages[2]
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [r.doc_id for r in before.collect() if not any(i in " ".join(r.text.split()) for i in items)]
    assert ids(after) == sorted(want)


def test_mixing(stages):
    before, after = stages[3]
    assert ids(after) == ids(mixing.mix(before).filter("sampled"))


def test_sharding(stages):
    before, after = stages[4]
    assert ids(after) == ids(before)
    slots = {}
    for r in after.collect():
        assert r["size"] == len(r.text.encode()) + 8
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, stages[-1][1].collect()), key=repr)


@pytest.mark.parametrize("make", [fixtures.odd, fixtures.none])
def test_odd_rows(spark, make):
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count()
        assert set(docs.columns) - {"size"} <= set(out.columns)


def test_one_of_a_group_stays(spark):
    odd = fixtures.odd(spark)
    got = corpus_pipeline.near_duplicates(spark, odd, SF).collect()
    # Texts without words are one group, the repeated long text another, and equal texts stay under the named id.
    assert sorted((r.doc_id or -1) for r in got) == [1, 4, 6, 7, 8, 9]
