"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint holds, for each of 64 bits, the majority among the hashes of a
text's word shingles. Equal fingerprints are united first, so only different
ones are joined, each once, whatever the number of its copies.

The join looks for pairs of fingerprints that differ in few bits. If at most
``k`` bits differ, one of ``k + 1`` blocks of bits is equal. So the bits are
rotated ``k + 1`` times to bring each block to the front, and a binary trie is
laid over each rotation. The traversal starts at the pairs of a node below the
first block with itself. A pair of nodes leads to the pairs of their children;
the bits in which the paths differ are added up, and a pair is dropped when they
exceed ``k``. Nodes with many fingerprints are opened in Spark, eight bits a
round, by joins on the child's path; once both nodes of a pair are small, the
rest of the traversal runs inside a task on two short sorted lists. A task gives
links that connect what it found, not all pairs, so a crowd of close
fingerprints gives as many links as members. Star rounds then name components.

Defined results: null text and text without words have fingerprint 0, linked
like any other. Repeated rows and null ids are kept; a component's name is the
smallest id that is not null (null if it has none). An empty table gives no
rows; columns beyond id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.components import components
from cellweave.llm.registry import query
from cellweave.llm.text import map_texts, table, text_key
from cellweave.session import cut_lineage

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BITS = 64
#: Bits by which a large node is opened in one round.
STEP = 8
#: Nodes of up to this many fingerprints are traversed inside a task.
LEAF = 1024


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles of a text, repeats included; of all its words if there are fewer."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    whole = b" ".join(found)
    if len(found) <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: 1 - shingle].tolist(), (ends[shingle - 1 :] - 1).tolist())
    return np.array([digest(whole[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, rows: int = 1 << 16) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), rows):
        part = hashes[at : at + rows].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by ``fp``."""
    return map_texts(
        docs.drop("fp"), lambda texts: ({"fp": fingerprint(t, shingle)} for t in texts), "fp long", text
    )


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of ``n`` items linked by index pairs."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root == root[root]).all():
            root = root[root]


def trie_pairs(x: np.ndarray, nodes: np.ndarray, depth: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of numbers that differ in few bits, from pairs of trie nodes.

    ``nodes`` has a column for each pair to start from: ``alo, ahi, blo, bhi,
    errors``. A node is a range of ``x``, sorted and equal in its first ``depth``
    bits; ``errors`` bits of the two paths to it differ so far. A node paired
    with itself gives each pair of its numbers once. All pairs of one level are
    split together.
    """
    alo, ahi, blo, bhi, err = nodes
    same = alo == blo
    left, right = [], []
    for level in range(depth, BITS + 1):
        single = (ahi - alo == 1) & (bhi - blo == 1) & ~same
        if single.any():  # two numbers: the rest of their paths at once
            i, j = alo[single], blo[single]
            rest = np.bitwise_count((x[i] ^ x[j]) << np.uint64(level)) if level < BITS else 0
            near = err[single] + rest <= max_bits
            left.append(i[near])
            right.append(j[near])
            alo, ahi, blo, bhi, err, same = (v[~single] for v in (alo, ahi, blo, bhi, err, same))
        if not len(alo) or level == BITS:
            break
        ones = np.concatenate([[0], np.cumsum((x >> np.uint64(BITS - 1 - level)) & np.uint64(1), dtype=np.int64)])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        apart = np.zeros_like(same)
        children = (
            (alo, amid, blo, bmid, err, same),
            (amid, ahi, bmid, bhi, err, same),
            (alo, amid, bmid, bhi, err + 1, apart),
            # Below a node paired with itself the mirrored pair is the same.
            (amid, np.where(same, amid, ahi), blo, bmid, err + 1, apart),
        )
        alo, ahi, blo, bhi, err, same = (np.concatenate(v) for v in zip(*children))
        keep = (ahi > alo) & (bhi > blo) & (err <= max_bits) & ~(same & (ahi - alo == 1))
        alo, ahi, blo, bhi, err, same = (v[keep] for v in (alo, ahi, blo, bhi, err, same))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _sorted_lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers of a list column, sorted inside each list, with the lists' ends."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    order = np.lexsort((values, np.repeat(np.arange(len(sizes)), sizes)))
    ends = np.cumsum(sizes)
    return values[order], ends - sizes, ends


def _link_leaves(max_bits: int, most: int = 4 * LEAF * LEAF):
    """For each pair of small nodes, links that connect the close fingerprints below them."""

    def links(batch: pa.RecordBatch):
        xs, alo, ahi = _sorted_lists(batch.column("xs"))
        ys, blo, bhi = _sorted_lists(batch.column("ys"))
        own = bhi == blo
        x = np.concatenate([xs, ys])
        blo, bhi = np.where(own, alo, blo + len(xs)), np.where(own, ahi, bhi + len(xs))
        errors, turns = (batch.column(n).to_numpy().astype(np.int64) for n in ("errors", "turn"))
        depth = batch.column("depth")[0].as_py()
        i, j = trie_pairs(x, np.stack([alo, ahi, blo, bhi, errors]), depth, max_bits)
        if not len(i):
            return
        root = smallest_linked(len(x), i, j)
        linked = np.flatnonzero(root != np.arange(len(x)))
        # Turn the numbers back into fingerprints.
        turn = np.zeros(len(x), np.int64)
        for lo, hi, t in zip(alo, ahi, turns):
            turn[lo:hi] = t
        for lo, hi, t in zip(blo, bhi, turns):
            turn[lo:hi] = t
        t = turn.astype(np.uint64)
        fp = np.where(t == 0, x, (x >> t) | (x << ((np.uint64(BITS) - t) % np.uint64(BITS)))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["u", "v"])

    def run(batches):
        for batch in batches:
            na = batch.column("xs").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            nb = batch.column("ys").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(na * np.where(nb > 0, nb, na)) // most
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                some = batch.slice(lo, hi - lo)
                for depth in pc.unique(some.column("depth")):
                    yield from links(some.filter(pc.equal(some.column("depth"), depth)))

    return run


def _masks(bits: int, max_bits: int) -> Column:
    """Differences of ``bits`` bits that are within the error budget, with their number of ones."""
    low = [(m, m.bit_count()) for m in range(1 << bits) if m.bit_count() <= max_bits]
    return F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("ones")) for m, n in low])


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """First bit and end of each of ``max_bits + 1`` blocks."""
    edges = [BITS * i // (max_bits + 1) for i in range(max_bits + 2)]
    return list(zip(edges, edges[1:]))


def _trie(start: int, end: int) -> Column:
    """A fingerprint turned to begin with a block, and its node below that block."""
    fp = F.col("fp")
    x = F.shiftleft(fp, start).bitwiseOR(F.shiftrightunsigned(fp, BITS - start)) if start else fp
    return F.struct(
        F.lit(start).alias("turn"),
        F.lit(end - start).alias("depth"),
        F.shiftrightunsigned(x, BITS - (end - start)).alias("a"),
        x.alias("x"),
    )


def close_links(fps: DataFrame, max_bits: int = MAX_BITS, leaf: int = LEAF, step: int = STEP) -> DataFrame:
    """``u, v``: links between different fingerprints that connect all that differ in up to ``max_bits`` bits.

    ``fps`` has one column ``fp`` of distinct longs.
    """
    tries = fps.select(F.explode(F.array(*[_trie(s, e) for s, e in _blocks(max_bits)])).alias("t")).select("t.*")
    nodes = tries.groupBy("turn", "depth", "a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tries = cut_lineage(tries.join(nodes, ["turn", "depth", "a"]))
    schema = "u long, v long"
    none = F.lit(None).cast("array<bigint>")

    # Nodes below a first block that are small: paired with themselves inside a task.
    small = tries.filter(F.col("n") <= leaf).groupBy("turn", "depth", "a").agg(F.collect_list("x").alias("xs"))
    found = [
        small.select("turn", "depth", F.lit(0).alias("errors"), "xs", none.alias("ys")).mapInArrow(
            _link_leaves(max_bits), schema
        )
    ]

    # Large ones: opened by the next bits, until the nodes of every pair are small.
    large = tries.filter(F.col("n") > leaf).select("turn", "depth", "a", "x")
    pairs = large.select("turn", "depth", F.col("a"), F.col("a").alias("b"), F.lit(0).alias("errors")).distinct()
    while not large.isEmpty():
        deeper = F.least(F.col("depth") + step, F.lit(BITS))
        path = F.call_function("shiftrightunsigned", F.col("x"), F.lit(BITS) - deeper)
        below = large.select("turn", "depth", "a", "x", path.alias("c"))
        children = cut_lineage(below.groupBy("turn", "depth", "a", "c").agg(F.count(F.lit(1)).alias("n")))
        opened = (
            pairs.join(children.select("turn", "depth", "a", "c", F.col("n").alias("na")), ["turn", "depth", "a"])
            .withColumn("m", F.explode(_masks(step, max_bits)))
            .withColumn("d", _join_path(F.col("b"), F.col("c"), deeper - F.col("depth")).bitwiseXOR(F.col("m.mask")))
            .withColumn("errors", F.col("errors") + F.col("m.ones"))
            .filter((F.col("errors") <= max_bits) & ((F.col("a") != F.col("b")) | (F.col("c") <= F.col("d"))))
        )
        others = children.select("turn", "depth", F.col("a").alias("b"), F.col("c").alias("d"), F.col("n").alias("nb"))
        opened = cut_lineage(
            opened.join(others, ["turn", "depth", "b", "d"])
            .filter("c != d or na > 1")
            .select("turn", deeper.alias("depth"), F.col("c").alias("a"), F.col("d").alias("b"), "errors", "na", "nb")
        )
        members = cut_lineage(below.select("turn", deeper.alias("depth"), F.col("c").alias("a"), "x"))
        ready = opened.filter((F.col("na") <= leaf) & (F.col("nb") <= leaf))
        wanted = ready.select("turn", "depth", "a").unionByName(
            ready.select("turn", "depth", F.col("b").alias("a"))
        ).distinct()
        lists = (
            members.join(wanted, ["turn", "depth", "a"], "left_semi")
            .groupBy("turn", "depth", "a")
            .agg(F.collect_list("x").alias("xs"))
        )
        twins = ready.filter("a = b").join(lists, ["turn", "depth", "a"]).withColumn("ys", none)
        apart = ready.filter("a != b").join(lists, ["turn", "depth", "a"]).join(
            lists.select("turn", "depth", F.col("a").alias("b"), F.col("xs").alias("ys")), ["turn", "depth", "b"]
        )
        cols = ["turn", "depth", "errors", "xs", "ys"]
        found.append(twins.select(cols).unionByName(apart.select(cols)).mapInArrow(_link_leaves(max_bits), schema))
        pairs = opened.filter((F.col("na") > leaf) | (F.col("nb") > leaf)).select("turn", "depth", "a", "b", "errors")
        still = pairs.select("turn", "depth", "a").unionByName(pairs.select("turn", "depth", F.col("b").alias("a")))
        large = members.join(still.distinct(), ["turn", "depth", "a"], "left_semi")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def _join_path(parent: Column, child: Column, bits: Column) -> Column:
    """The path of ``parent`` followed by the last ``bits`` bits of ``child``."""
    low = child.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    return F.call_function("shiftleft", parent, bits).bitwiseOR(low)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = cut_lineage(fingerprints(rows, shingle))
    return marked.join(name_components(marked, max_bits), "fp").select("doc_id", "fp", "component_id")


def name_components(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, root, component_id`` for each different fingerprint of ``marked`` (``doc_id, fp``)."""
    known = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(close_links(known.select("fp"), max_bits))
    rooted = known.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(names, "root").select("fp", "root", "component_id")


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row of each group of near-duplicates, with its own columns.

    The row with the smallest id stays, a null id coming last; among those of
    one id, a hash of the text decides, and among equal ones any.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), text_key(doc_id, text).alias("key"), F.col(text).alias("text")
    )
    marked = cut_lineage(fingerprints(rows, shingle))
    named = marked.join(name_components(marked, max_bits).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    kept = named.groupBy("root").agg(first).select(F.col("first.key").alias("_key"))
    stay = docs.withColumn("_key", text_key(doc_id, text)).join(kept, "_key", "left_semi")
    return stay.dropDuplicates(["_key"]).select(*docs.columns)


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
