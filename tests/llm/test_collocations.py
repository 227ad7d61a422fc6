"""Collocations against counting in Python."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import collocations as co
from cellweave.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, lang string, text string"


def brute(rows, least, top, longest=5):
    out = []
    for lang in {r[1] or "und" for r in rows}:
        counts, n = Counter(), 0
        for _, other, text in rows:
            if (other or "und") != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                counts.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
        often = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            longer = [q for q in often if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(often[q] >= a for q in longer):
                continue
            score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def rows_of(seed, docs=60):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "New", "york", "ÉTÉ", "été", "of ", "日本", "a", "b", "c", "\x1cx"]
    joints = [" ", "\t ", " ", " ", ", ", "\n", ". ", "\r\x0b"]
    out = []
    for i in range(docs):
        words = rng.choice(vocabulary, rng.integers(0, 60))
        text = "".join(w + joints[j] for w, j in zip(words, rng.integers(0, len(joints), len(words))))
        out.append((i, [None, "en", "und", "fr"][i % 4], text + " new york City hall new york city hall"))
    return out + [(None, "en", out[1][2])] * 3 + [(7, "fr", None), (8, "xx", None), (9, "en", " \t.,"), (10, None, "")]


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS n", "1 AS phrase", "2 AS _salt").repartition(3)
    got = co.collocations(df, **more)
    return sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("bits", [64, 5])
def test_against_brute_force(spark, bits):
    rows = rows_of(1)
    assert result(spark, rows, least=6, top=40, bits=bits) == brute(rows, 6, 40)


def test_no_phrases(spark):
    assert result(spark, [(1, "en", "a b c")], least=5) == []
    assert result(spark, [(1, "en", None)], least=1) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert co.collocations(empty).count() == 0


def test_long_texts_are_cut_between_pieces():
    text = "one two three. " * 50 + "x" * 900 + " y, " + "four five! " * 40
    for limit in (64, 300, 10_000):
        rebuilt, where = "", []
        for data, rows, places in co.chunks(pa.array([text, None, "a b", ""]), limit):
            for row, first, offset in zip(rows, places[0], places[1]):
                if row == 0:
                    end = bytes(data[first:]).index(b"\0") if b"\0" in bytes(data[first:]) else None
                    assert end is None and text.encode()[offset : offset + 3] == bytes(data[first : first + 3])
                where.append((int(row), int(offset)))
            rebuilt += bytes(data).decode()
        assert [w for w in where if w[0] == 0][0] == (0, 0) and (2, 0) in where
        assert re.findall(r"[a-z]+", rebuilt) == re.findall(r"[a-z]+", text + " a b")


def test_long_texts_give_the_same(spark):
    rows = [(1, "en", "up and down the hill; " * 30_000), (2, "en", "up and down again " * 200)]
    assert result(spark, rows, least=100, top=50) == brute(rows, 100, 50)


def test_pointers_show_the_phrase(spark):
    rows = rows_of(2)
    texts = {str(i): t for i, _, t in rows if i is not None and t}
    found = co.frequent_phrases(spark.createDataFrame(rows, SCHEMA), least=8).filter("n_words > 1 AND doc_id IS NOT NULL").collect()
    assert found
    for r in found:
        if r["doc_id"] in ("7", "8", "9", "10"):
            continue  # ids of more than one row
        rest = texts[r["doc_id"]].encode()[r["place"] :].decode().translate(LOWER)
        assert re.findall(r"[^\x20\x09]+", re.split(r"[.,;:!?\x0A-\x0D]", rest)[0])[: r["n_words"]] == r["phrase"].split(" ")


def test_query_equals_sql(spark):
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = QUERIES["op13_collocations"](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES['op13_collocations']})").fetchall()
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(want) and want


def test_only_phrases_of_passing_parts_are_spelled(spark, monkeypatch):
    """A task that spells holds no phrase, and numbers no word, that counting has ruled out; rows come in parts."""
    monkeypatch.setattr(co, "ROWS", 7)
    rows = [(i, "en", " ".join(f"{w} new york" for w in (f"a{i}", f"b{i}", f"c{i}"))) for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA).select("lang", "text", "doc_id").coalesce(2)
    bits, sieves = 6, []  # fingerprints of 6 bits, so that many pass that are rare
    for n in (1, 2, 3):
        counted = co.count_fingerprints(docs, n, sieves[-1] if sieves else None, bits)
        sieves.append(spark.sparkContext.broadcast(co.sieve_of(counted.filter("n >= 100").select("fp"), spark)))
    spelled = {r["phrase"] for r in co.spell(docs, sieves, bits).filter("n_words > 0").collect()}
    assert {"new york", "york", "new"} <= spelled
    for phrase in spelled:
        words = phrase.split(" ")
        assert len(words) == 1 or {" ".join(words[1:]), " ".join(words[:-1])} <= spelled
