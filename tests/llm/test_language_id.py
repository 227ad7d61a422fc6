"""Language identification: held-out accuracy, rejection, odd rows."""

import numpy as np
import pytest

import fixtures
from cellweave.llm import language_id


@pytest.fixture(scope="module")
def model(spark):
    return language_id.learn_languages(fixtures.documents(spark, "sf0.01"))


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in fixtures.documents(spark, "sf0.01").collect()}
    got = language_id.op9_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert len(held) > 250
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_grams_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "Grüße aus dem Süden, 123 " * 50
    whole = np.bincount(np.concatenate([language_id.grams(p) for p in language_id.pieces(text)]), minlength=1 << 14)
    monkeypatch.setattr(language_id, "PIECE", 64)
    parts = np.zeros_like(whole)
    for p in language_id.pieces(text):
        parts += np.bincount(language_id.grams(p), minlength=1 << 14)
    # Shorter n-grams of the few shared bytes are counted twice; all others once.
    assert (parts >= whole).all() and parts.sum() - whole.sum() <= 3 * len(list(language_id.pieces(text)))


def test_odd_rows(spark, model):
    got = language_id.identify(fixtures.odd(spark).select("doc_id", "text", "score"), model).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert len(got) == len(fixtures.ROWS)
    assert by_id[1] == by_id[2] == by_id[3] == by_id[7] == {("und", 0.0)}
    assert all(len(x) == 1 for x in by_id.values())
    assert {x for x, _ in by_id[4]} == {"en"}
    assert language_id.identify(fixtures.none(spark).select("doc_id", "text"), model).count() == 0


def test_nothing_to_learn_from(spark):
    model = language_id.learn_languages(fixtures.none(spark))
    got = language_id.identify(fixtures.odd(spark).select("doc_id", "text"), model).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_strange_text_is_rejected(spark, model):
    rows = spark.createDataFrame([("qqq zzz xxxx kkkk wwww",), ("the house is in the land and it was of them to see",)], "text string")
    strange, plain = (r.score for r in language_id.identify(rows, model).collect())
    assert strange < plain
