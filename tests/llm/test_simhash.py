"""SimHash near-duplicates against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from cellweave.llm import simhash
from cellweave.llm.components import components


def brute_fingerprint(text):
    words = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, max_bits):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(root)
    for i, x in enumerate(nodes):
        for y in nodes[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= max_bits:
                root[find(x)] = find(y)
    return {x: find(x) for x in nodes}


def partition(names):
    groups = {}
    for x, name in names.items():
        groups.setdefault(name, set()).add(x)
    return {frozenset(g) for g in groups.values()}


def crowd(rng, centres, members, flips):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(members):
            x = c
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "Two words", "A b\tc\x0bd É\xa0f g", "x y z " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


def test_trie_pairs_are_all_close_pairs():
    rng = random.Random(1)
    x = np.array(sorted(v % 2**64 for v in crowd(rng, 3, 60, 4)), np.uint64)
    n = len(x)
    nodes = np.array([[0], [n], [0], [n], [0]])
    i, j = simhash.trie_pairs(x, nodes, 0, 2)
    found = [tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())]
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if int(x[a] ^ x[b]).bit_count() <= 2}
    assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("leaf", [1024, 4])
def test_links_connect_all_close_fingerprints(spark, leaf):
    rng = random.Random(leaf)
    fps = crowd(rng, 6, 40, 3) + [0, -1, 1, -(2**63)]
    df = spark.createDataFrame([(x,) for x in sorted(set(fps))], "fp long")
    links = [(r.u, r.v) for r in simhash.close_links(df, leaf=leaf).collect()]
    assert all(((u ^ v) & (2**64 - 1)).bit_count() > 0 for u, v in links)
    found = components(spark.createDataFrame(links, "u long, v long"))
    names = {x: x for x in fps} | {r.node: r.root for r in found.collect()}
    assert partition(names) == partition(brute_components(fps, 2))


def test_near_duplicates_of_odd_rows(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30
    rows = [(7, base), (3, base.upper()), (9, base + "omega"), (4, None), (5, ""), (None, "lone text here"), (8, "solo"), (8, "solo")]
    rows = [(i, t, "x") for i, t in rows]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = {t: simhash.fingerprint(t) for _, t, _ in rows}
    names = brute_components(set(fps.values()), 2)
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[names[fps[t]]] = min(i, first.get(names[fps[t]], i))
    want = sorted(((i, fps[t], first.get(names[fps[t]])) for i, t, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=repr) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    names = brute_components(set(fps.values()), 2)
    first = {}
    for i, fp in fps.items():
        first[names[fp]] = min(i, first.get(names[fp], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, sf).collect()}
    assert got == {i: (f"{fp:016x}", first[names[fp]]) for i, fp in fps.items()}
