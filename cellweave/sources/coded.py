"""Layers stored as run-length coded rows, in equal buckets, so that overlays need no shuffle.

A record holds a block of ``WIDTH`` columns of one grid row: the ends of its runs
of equal value, as offsets from the block's first column, and a value for each run
(null is NoData). Columns without a cell belong to no run. Tables with the same
number of buckets by row and block are joined where they lie, and the runs of the
joined layers are cut at each other's ends: a cell is spelled out only where cells
are asked for, and counts come from the lengths of runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import div

WIDTH = 1024
#: Rows whose pieces are united in one call.
ROWS = 64
KEY = ["r", "b"]
CODED = "r long, b long, c0 array<int>, c1 array<int>, v array<int>"


def code_runs(at: np.ndarray, c: np.ndarray, v: np.ndarray, known: np.ndarray):
    """Runs of sorted cells: which begin one. ``at`` names the record of a cell."""
    first = np.ones(len(c), bool)
    same = (at[1:] == at[:-1]) & (c[1:] == c[:-1] + 1) & (known[1:] == known[:-1]) & ((v[1:] == v[:-1]) | ~known[1:])
    first[1:] = ~same
    return first


def encode(layer: DataFrame, width: int = WIDTH) -> DataFrame:
    """``r, c, v`` as coded records, one for each row and block; a repeated cell is an error."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _coded(batch, width)

    def unite(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["band"])
        if len(np.unique(table["r"].to_numpy())) == table.num_rows:
            return table
        r, b, c, v, known = _cells(table, width)
        cells = pa.RecordBatch.from_arrays(
            [pa.array(r), pa.array(c), pa.array(v, pa.int32(), mask=~known)], names=["r", "c", "v"]
        )
        return pa.Table.from_batches([_coded(cells, width)])

    cells = layer.select(F.col("r").cast("long"), F.col("c").cast("long"), F.col("v").cast("int"))
    packed = cells.mapInArrow(pack, CODED).withColumn("band", div(F.col("r"), ROWS))
    return packed.groupBy("band", "b").applyInArrow(unite, CODED)


def _coded(cells: pa.RecordBatch, width: int) -> pa.RecordBatch:
    r, c = cells.column(0).to_numpy(), cells.column(1).to_numpy()
    order = np.lexsort((c, r))
    r, c = r[order], c[order]
    v, known = cells.column(2).fill_null(0).to_numpy()[order], cells.column(2).is_valid().to_numpy(zero_copy_only=False)[order]
    if ((np.diff(r) == 0) & (np.diff(c) == 0)).any():
        raise ValueError("a cell occurs twice in a layer")
    b = c // width
    at = np.cumsum(np.concatenate(([0], (np.diff(r) != 0) | (np.diff(b) != 0))))
    first = np.flatnonzero(code_runs(at, c, v, known))
    last = np.append(first[1:], len(c)) - 1
    offset = (c - b * width).astype(np.int32)
    record = np.flatnonzero(np.concatenate(([True], np.diff(at[first]) != 0)))
    ends = pa.array(np.append(record, len(first)).astype(np.int32))
    lists = [offset[first], offset[last], pa.array(v[first].astype(np.int32), mask=~known[first])]
    return pa.RecordBatch.from_arrays(
        [pa.array(r[first[record]]), pa.array(b[first[record]]), *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists]],
        names=["r", "b", "c0", "c1", "v"],
    )


def _lengths(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.value_lengths().to_numpy(zero_copy_only=False), array.flatten()


def _cells(table, width: int):
    """Rows, blocks, columns, values and flags of the cells in coded records."""
    count, c0 = _lengths(table["c0"])
    c0, c1 = c0.to_numpy().astype(np.int64), _lengths(table["c1"])[1].to_numpy().astype(np.int64)
    values = _lengths(table["v"])[1]
    size = c1 - c0 + 1
    of = np.repeat(np.repeat(np.arange(len(count)), count), size)
    r, b = table["r"].to_numpy()[of], table["b"].to_numpy()[of]
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    c = b * width + np.repeat(c0, size) + inside
    return r, b, c, np.repeat(values.fill_null(0).to_numpy(), size), np.repeat(values.is_valid().to_numpy(zero_copy_only=False), size)


def write_coded(layer: DataFrame, table: str, path: str, buckets: int, width: int = WIDTH) -> None:
    """Store one layer as a table of coded records in buckets by row and block."""
    (
        encode(layer, width)
        .repartition(buckets, *KEY)
        .sortWithinPartitions(*KEY)
        .write.mode("overwrite")
        .bucketBy(buckets, *KEY)
        .sortBy(*KEY)
        .option("path", path)
        .saveAsTable(table)
    )


def overlay_runs(tables: dict[str, DataFrame], width: int = WIDTH) -> DataFrame:
    """``r, c0, c1`` and a value of each coded layer, for runs on which no layer changes.

    Only columns that every layer has cells for are in it. Tables in equal
    buckets are joined without a shuffle, others are shuffled record by record.
    """
    names = list(tables)
    if clash := {"r", "c", "c0", "c1"} & set(names):
        raise ValueError(f"layers may not be named like places: {sorted(clash)}")
    frames = [
        df.select(*KEY, *[F.col(x).alias(f"{x}_{i}") for x in ("c0", "c1", "v")]) for i, df in enumerate(tables.values())
    ]
    joined = reduce(lambda a, b: a.hint("merge").join(b, KEY), frames)
    values = ", ".join(f"`{name}` int" for name in names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _merged(batch, names, width)

    return joined.mapInArrow(merge, f"r long, c0 long, c1 long, {values}")


def _merged(batch: pa.RecordBatch, names: list[str], width: int) -> pa.RecordBatch:
    """The runs of joined records, cut at the ends of all layers' runs.

    The columns of all records are laid end to end with a gap after each. A
    run of the result begins where a run of any layer begins or ends, and lies
    in the run of a layer that begins last before it, if that reaches so far.
    """
    starts, ends, values = [], [], []
    step = width + 1
    for i in range(len(names)):
        count, c0 = _lengths(batch[f"c0_{i}"])
        base = np.repeat(np.arange(batch.num_rows, dtype=np.int64) * step, count)
        starts.append(base + c0.to_numpy())
        ends.append(base + _lengths(batch[f"c1_{i}"])[1].to_numpy() + 1)
        values.append(_lengths(batch[f"v_{i}"])[1])
    cuts = np.unique(np.concatenate([*starts, *ends]))
    first, after = cuts[:-1], cuts[1:]
    inside, picks = np.ones(len(first), bool), []
    for s, e in zip(starts, ends):
        at = np.searchsorted(s, first, side="right") - 1
        inside &= (at >= 0) & (e[at] >= after)
        picks.append(at)
    row = first[inside] // step
    r, base = batch["r"].to_numpy()[row], batch["b"].to_numpy()[row] * width - row * step
    return pa.RecordBatch.from_arrays(
        [pa.array(r), pa.array(base + first[inside]), pa.array(base + after[inside] - 1), *[v.take(pa.array(p[inside])) for v, p in zip(values, picks)]],
        names=["r", "c0", "c1", *names],
    )


def overlay_coded(tables: dict[str, DataFrame], width: int = WIDTH) -> DataFrame:
    """The stack of coded layers, one row per cell: ``r, c`` and a column per layer."""
    runs = overlay_runs(tables, width)
    return runs.withColumn("c", F.explode(F.sequence("c0", "c1"))).select("r", "c", *tables)

