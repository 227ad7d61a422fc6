"""Masks as quadtree covers: whole nodes inside, leaves with bitmaps on the border.

Nodes are intervals of Morton numbers (the bits of row and column interleaved), so
a cell lies in the cover if its number lies in an interval, and, where that is a
leaf on the border, if its bit is set there. A cover grows with the length of the
border: a leaf of ``LEAF`` by ``LEAF`` cells costs 512 bytes, a whole node 16 and
neighbouring ones are united; only one in ``BLOCK ** 2`` cells of the interior costs
a node of its own while the cover is made. A cover is broadcast if its bytes are
counted to be few; else cells, packed by square, meet the nodes of their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.runs import in_blocks
from cellweave.session import cut_lineage, div

LEAF_BITS, BLOCK_BITS = 6, 10
LEAF, BLOCK = 1 << LEAF_BITS, 1 << BLOCK_BITS
#: Squares by which packed cells and nodes meet where the cover is not broadcast.
SQUARE_BITS = 8
#: A cover of up to this many bytes is broadcast.
COVER_BYTES = 32 << 20
#: Rows and columns lie within this distance of 0, so that Morton numbers fit 60 bits.
REACH = 1 << 29
NODES = "z0 long, z1 long, bits binary"

_SPREAD = [
    (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555),
]


def _spread(x: np.ndarray) -> np.ndarray:
    """Each bit of a number moved to twice its place."""
    x = x.astype(np.uint64)
    for shift, keep in _SPREAD:
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def morton(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    if len(r) and (min(r.min(), c.min()) < -REACH or max(r.max(), c.max()) >= REACH):
        raise ValueError(f"rows and columns have to lie from {-REACH} to {REACH - 1}")
    return ((_spread(r + REACH) << np.uint64(1)) | _spread(c + REACH)).astype(np.int64)


def _nodes(flags: np.ndarray, r0: int, c0: int) -> tuple[list[np.ndarray], list[np.ndarray], list[bytes]]:
    """The nodes of a square of flags: begins, ends, and the bitmaps of the last ones.

    Squares of ``LEAF`` are looked at first; four whole ones become one, level
    by level.
    """
    side = len(flags) // LEAF
    leaves = flags.reshape(side, LEAF, side, LEAF).swapaxes(1, 2)
    whole, some = leaves.all(axis=(2, 3)), leaves.any(axis=(2, 3))
    begins, ends = [], []
    size = LEAF
    border = some & ~whole
    i, j = np.nonzero(border)
    bitmaps = [b.tobytes() for b in np.packbits(leaves[i, j].reshape(len(i), LEAF * LEAF), axis=1)]
    last = morton(r0 + i * LEAF, c0 + j * LEAF)
    while True:
        four = whole.reshape(len(whole) // 2, 2, len(whole) // 2, 2).all(axis=(1, 3)) if len(whole) > 1 else np.zeros((0, 0), bool)
        alone = whole & ~np.kron(four, np.ones((2, 2), bool)) if len(whole) > 1 else whole
        i, j = np.nonzero(alone)
        z = morton(r0 + i * size, c0 + j * size)
        begins.append(z)
        ends.append(z + size * size)
        if len(whole) == 1:
            break
        whole, size = four, 2 * size
    return [*begins, last], [*ends, last + LEAF * LEAF], bitmaps


def cover(runs: DataFrame) -> DataFrame:
    """The nodes ``z0, z1, bits`` of a set of runs; ``bits`` is null for whole nodes."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        r0, c0 = key[0].as_py() * BLOCK, key[1].as_py() * BLOCK
        step = np.zeros((BLOCK, BLOCK + 1), np.int32)
        r = table["r"].to_numpy() - r0
        np.add.at(step, (r, table["c0"].to_numpy() - c0), 1)
        np.add.at(step, (r, table["c1"].to_numpy() - c0 + 1), -1)
        flags = np.cumsum(step[:, :BLOCK], axis=1) > 0
        begins, ends, bitmaps = _nodes(flags, r0, c0)
        z0, z1 = np.concatenate(begins), np.concatenate(ends)
        bits = pa.array([None] * (len(z0) - len(bitmaps)) + bitmaps, pa.binary())
        return pa.Table.from_arrays([pa.array(z0), pa.array(z1), bits], names=["z0", "z1", "bits"])

    pieces = in_blocks(runs.select("r", "c0", "c1"), BLOCK).withColumn("band", div(F.col("r"), BLOCK))
    return pieces.groupBy("band", "block").applyInArrow(build, NODES)


@dataclass(frozen=True)
class Cover:
    """Sorted disjoint intervals; ``leaf`` is the row of ``bits`` of an interval, -1 where it is whole."""

    z0: np.ndarray
    z1: np.ndarray
    leaf: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Cover:
        z0, z1 = table["z0"].to_numpy(), table["z1"].to_numpy()
        border = table["bits"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        maps = [b.as_py() for b in table["bits"].combine_chunks().drop_null()]
        leaf = np.full(len(z0), -1)
        leaf[border] = np.arange(len(maps))
        order = np.argsort(z0)
        z0, z1, leaf = z0[order], z1[order], leaf[order]
        # Whole neighbours become one interval.
        first = np.ones(len(z0), bool)
        first[1:] = (z0[1:] != z1[:-1]) | (leaf[1:] >= 0) | (leaf[:-1] >= 0)
        start = np.flatnonzero(first)
        z1 = z1[np.append(start[1:], len(z0)) - 1] if len(start) else z1
        bits = np.frombuffer(b"".join(maps), np.uint8).reshape(-1, LEAF * LEAF // 8)
        return Cover(z0[start], z1, leaf[start], bits)

    def holds(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Whether each cell lies in the cover."""
        if not len(self.z0) or not len(r):
            return np.zeros(len(r), bool)
        z = morton(r, c)
        at = np.searchsorted(self.z0, z, side="right") - 1
        inside = (at >= 0) & (z < self.z1[at])
        border = np.flatnonzero(inside & (self.leaf[at] >= 0))
        place = (r[border] & (LEAF - 1)) * LEAF + (c[border] & (LEAF - 1))
        bit = self.bits[self.leaf[at[border]], place >> 3] >> (7 - (place & 7))
        inside[border] = bit & 1 > 0
        return inside


def cover_bytes(nodes: DataFrame) -> int:
    row = nodes.agg(F.count("*"), F.sum(F.octet_length("bits"))).first()
    return 16 * row[0] + (row[1] or 0)


def _result(rows: pa.RecordBatch | pa.Table, held: np.ndarray, flag: str | None):
    if flag is None:
        return rows.filter(pa.array(held))
    return type(rows).from_arrays([*rows.columns, pa.array(held)], names=[*rows.schema.names, flag])


def inside(
    cells: DataFrame,
    runs: DataFrame,
    flag: str | None = None,
    limit: int = COVER_BYTES,
    then: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str] | None = None,
) -> DataFrame:
    """Cells that lie in a set of runs; with ``flag`` all cells, and that column to tell which do.

    One pass over the cells where they are, if the cover has up to ``limit``
    bytes. Else cells are packed by squares, hashed by those, and meet the nodes
    of their square; larger nodes are cut into squares. ``then`` is what
    ``mapInArrow`` is to do with the result, in the same pass where there is one.
    """
    return _meet_cover(cells, cut_lineage(cover(runs)), flag, limit, then)


def flags(
    cells: DataFrame,
    sets: dict[str, DataFrame],
    then: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str],
    limit: int = COVER_BYTES,
) -> DataFrame:
    """All cells, with a column for each set of runs that tells which lie in it, handed to ``then``.

    One pass over the cells, so one Python worker a task, if all covers together
    have up to ``limit`` bytes; else each cover is met by itself.
    """
    nodes = {name: cut_lineage(cover(runs)) for name, runs in sets.items()}
    go_on, schema = then
    if sum(map(cover_bytes, nodes.values())) > limit:
        *before, last = nodes
        for name in before:
            cells = _meet_cover(cells, nodes[name], name, limit)
        return _meet_cover(cells, nodes[last], last, limit, then)
    known = cells.sparkSession.sparkContext.broadcast({name: Cover.of(n.toArrow()) for name, n in nodes.items()})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [batch.column(x).cast(pa.int64()).to_numpy() for x in ("r", "c")]
            for name, held in known.value.items():
                batch = _result(batch, held.holds(*places), name)
            yield batch

    return cells.mapInArrow(lambda batches: go_on(mark(batches)), schema)


def _meet_cover(cells: DataFrame, nodes: DataFrame, flag: str | None, limit: int, then=None) -> DataFrame:
    """What ``inside`` gives, by the nodes of a cover."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    schema = fields if flag is None else f"{fields}, `{flag}` boolean"

    def places(rows):
        return (rows.column(x).cast(pa.int64()).to_numpy() for x in ("r", "c"))

    if cover_bytes(nodes) <= limit:
        known = cells.sparkSession.sparkContext.broadcast(Cover.of(nodes.toArrow()))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _result(batch, known.value.holds(*places(batch)), flag)

        if then is None:
            return cells.mapInArrow(mark, schema)
        go_on, schema = then
        return cells.mapInArrow(lambda batches: go_on(mark(batches)), schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = pa.Table.from_struct_array(pa.chunked_array([x.flatten() for x in left["rows"].chunks], left.schema.field("rows").type.value_type))
        return _result(rows, Cover.of(right).holds(*places(rows)), flag)

    square = 2 * SQUARE_BITS
    first = F.explode(F.sequence(F.col("z0"), F.col("z1") - 1, F.lit(1 << square).cast("long")))
    cut = nodes.filter(F.col("z1") - F.col("z0") > 1 << square).withColumn("z0", first)
    cut = cut.withColumn("z1", F.col("z0") + (1 << square))
    small = nodes.filter(F.col("z1") - F.col("z0") <= 1 << square).unionByName(cut)
    keyed = small.withColumn("square", F.shiftright("z0", square))
    packed = _by_square(cells)
    found = packed.groupBy("square").cogroup(keyed.groupBy("square")).applyInArrow(meet, schema)
    return found if then is None else found.mapInArrow(*then)


def _by_square(cells: DataFrame) -> DataFrame:
    """Cells as records of a square, packed batch by batch before they are shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = morton(*(batch.column(x).cast(pa.int64()).to_numpy() for x in ("r", "c"))) >> (2 * SQUARE_BITS)
            order = np.argsort(z, kind="stable")
            z = z[order]
            start = np.flatnonzero(np.concatenate(([True], np.diff(z) != 0)))
            rows = pa.StructArray.from_arrays(batch.take(pa.array(order)).columns, names=batch.schema.names)
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(z)).astype(np.int32)), rows)
            yield pa.RecordBatch.from_arrays([pa.array(z[start]), lists], names=["square", "rows"])

    return cells.mapInArrow(pack, f"square long, rows array<{cells.schema.simpleString()}>")
