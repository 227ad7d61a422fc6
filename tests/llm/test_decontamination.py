"""Decontamination against plain search, with re-parameterised questions and odd rows."""

import numpy as np
import pytest

import fixtures
from cellweave.llm import decontamination as dc

ITEM = (
    "A train leaves Boston at 40 miles per hour and another train leaves Denver at 55 miles per hour. "
    "If Boston is 300 miles away, how many hours until the trains meet near the old bridge?"
)
OTHER = "Which gas do plants take in from the air when they make sugar out of light and water during the day?"
NOISE = "she said that nothing of the kind had ever been seen in this part of the country before that day"


def found(spark, texts, items=(ITEM, OTHER)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in dc.contaminated(docs, bench).collect()}


def test_changed_numbers_and_names(spark):
    changed = ITEM.replace("Boston", "Lisbon").replace("Denver", "Madrid").replace("40", "62").replace("55", "70").replace("300", "410")
    torn = ITEM.replace("Boston", "Lisbon", 1)  # the same name now stands for two
    got = found(spark, [f"{NOISE}. {ITEM} {NOISE}", f"{NOISE}.\n{changed}", torn, NOISE, f"{NOISE} {OTHER.upper()}"])
    assert set(got) == {(0, 0), (1, 0)}
    assert not got[0, 0].changed and got[1, 0].changed
    assert got[0, 0].matched_words == got[0, 0].item_words == 36


def test_part_of_an_item(spark):
    words = OTHER.split()
    got = found(spark, [NOISE + ". " + " ".join(words[4:18]) + " " + NOISE, NOISE + " " + " ".join(words[4:13]) + " " + NOISE])
    assert set(got) == {(0, 1)}


def test_short_items_and_slots_only(spark):
    items = ["make sugar from light water", "two words", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", None, ""]
    texts = ["they make sugar from light water today", "two words two words", "9 8 7 6 5 4 3 2 1 0 9 8 7 6 5", None, "", " ".join(["x"] * 5000)]
    assert set(found(spark, texts, items)) == {(0, 0)}


def test_copies_with_many_slots_in_any_context(spark):
    items = [
        "12 + 7 = 19 , 31 - 4 = 27 , 8 * 9 = 72 and 90 / 6 = 15 so 5 + 6",
        "Present were Anna Berg, Boris Clay, Carla Dorn, David Eck, Edith Frey, Frank Gold and Greta Hall",
        "Which planet is closest to the sun",
        "Did Anna Berg ask Nasa staff whether Boris Clay had met Carla Dorn in Rome or Paris",
        "Ask Anna Berg in Rome",
    ]
    texts = [f"{NOISE} {items[0]} {NOISE}", f"{NOISE}: {items[1]}", f"Q: {items[2]} A: no", items[3].lower(), items[3].title(), f"{NOISE} {items[4]}"]
    assert set(found(spark, texts, items)) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 4)}


def test_largest_consistent_part_and_neighbouring_alignments(spark):
    three = (
        "When Alice walked to the market she bought some apples and then went home again. Later that day Alice cooked the apples "
        "with sugar and a little water. In the evening Alice ate them with 3 friends and 5 cousins at the table."
    )
    twenty = "Which of the gases found in the air do most green plants take in when they make sugar from water"
    items = [three, twenty, "The box holds 3 red balls and 5 blue balls, so how many balls are in the box"]
    words = twenty.split()
    texts = [
        three.replace("Alice cooked", "Alicia cooked").replace("Later that day", "Later then"),  # one mention of three
        three.replace("day Alice", "day Carol").replace("with 3", "with 4").replace("and 5", "and 4"),
        " ".join([*words[:10], "really", *words[10:]]),
        " ".join([*words[:9], *words[11:]]),
        items[2].replace("3", "4").replace("5", "4"),
    ]
    got = found(spark, texts, items)
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)}
    assert got[2, 1].matched_words == got[2, 1].item_words == 20 and got[4, 2].changed


def test_templates():
    t = dc.Templates()
    owner, at, slot, _ = t.batch(["Hello there, Anna paid 12 kg. The 5% ... Then Bob! km", None, "", "New text"])
    assert [t.cores[i] for i in at] == ["Hello", "there", "Anna", "paid", "12", "kg", "The", "5%", "Then", "Bob", "km", "New", "text"]
    assert slot.tolist() == [0, 0, 3, 0, 1, 2, 0, 1, 0, 3, 0, 0, 0]
    assert owner.tolist() == [0] * 11 + [3] * 2


def test_rolling_hashes_are_those_of_the_words():
    t = dc.Templates()
    words = [f"w{i % 7}" for i in range(60)]
    owner, _, slot, hashes = t.batch([" ".join(words[:40]), " ".join(words[40:])])
    at, rolled = t.windows(owner, slot, hashes, 8)
    assert at.tolist() == [i for i in range(53) if i <= 32 or i >= 40]
    same = {}
    for i, h in zip(at.tolist(), rolled.tolist()):
        assert same.setdefault(tuple(words[i : i + 8]), h) == h
    assert len(set(same.values())) == len(same)


def test_bitmap(spark):
    hashes = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 3000)
    held = np.frombuffer(dc._bitmap(spark.createDataFrame([(int(h),) for h in hashes], "hash long")), np.uint8)
    place = (hashes.view(np.uint64) >> np.uint64(64 - dc.BITMAP_BITS)).astype(np.int64)
    assert len(held) == 1 << 21
    assert np.flatnonzero(np.unpackbits(held, bitorder="little")).tolist() == sorted(set(place.tolist()))


def test_query_against_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: " ".join(r.text.split()) for r in fixtures.documents(spark, "sf0.01").collect()}
    items = {r.item_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, text in docs.items() for i, item in items.items() if item in text}
    assert {(r.doc_id, r.item_id) for r in dc.op10_decontamination(spark, sf).collect()} == want


@pytest.mark.parametrize("docs, bench", [("odd", "none"), ("none", "odd"), ("odd", "odd")])
def test_odd_rows(spark, docs, bench):
    left, right = getattr(fixtures, docs)(spark), getattr(fixtures, bench)(spark)
    kept = dc.decontaminate(left, right.withColumnRenamed("doc_id", "item_id"))
    assert kept.columns == left.columns
    # Texts of four words and more hold themselves; shorter ones hold nothing.
    lost = {4, None, 7, 8, 9} if docs == bench == "odd" else set()
    want = sorted((i or -1) for i, *_ in (fixtures.ROWS if docs == "odd" else []) if i not in lost)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == want
