"""Exact Euclidean distance to the nearest cell of a class, however far it is.

The grid is cut into bands of whole rows, so low that a band of the grid's width
fits a task. In each column the nearest flagged rows above and below a band are
carried across bands: only the first and last flagged row of a band and column
travel for that, packed by blocks of columns. A band then knows for each of its
rows and all columns the distance along the column, and the distance along the row
is found from the lower envelope of parabolas, one per column, for all rows of
the band at once. All arithmetic is in whole numbers until the last square root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.tiles import _packed, _unpacked
from cellweave.session import cut_lineage, div, shuffle_partitions

#: Cells of a band at most, and columns whose carries are found together.
BAND_CELLS, COLUMNS = 1 << 21, 256
#: A distance along a column that no grid has, and its square; both fit the arithmetic of ``envelope``.
NONE = 1 << 30
FAR = NONE * NONE


def envelope(column: np.ndarray) -> np.ndarray:
    """For each cell the least ``column[r, u] + (c - u) ** 2`` over all columns u, rows side by side.

    ``column`` has squared distances along columns. The stack of each row holds
    the parabolas of its envelope so far and where each begins to be the lowest.
    """
    height, width = column.shape
    at, begin = np.zeros((height, width + 1), np.int64), np.zeros((height, width + 1), np.int64)
    top, rows = np.zeros(height, np.int64), np.arange(height)

    def value(x, u):
        return (x - u) ** 2 + column[rows_now, u]

    for u in range(1, width):
        rows_now = rows
        while True:  # parabolas that the new one hides from their begin on
            last, x = at[rows_now, top[rows_now]], begin[rows_now, top[rows_now]]
            hidden = value(x, last) > (x - u) ** 2 + column[rows_now, u]
            rows_now = rows_now[hidden]
            if not len(rows_now):
                break
            top[rows_now] -= 1
            rows_now = rows_now[top[rows_now] >= 0]
            if not len(rows_now):
                break
        empty = top < 0
        last = at[rows, np.maximum(top, 0)]
        # From here on the new parabola is lower than the last one.
        meet = 1 + (u * u - last * last + column[:, u] - column[rows, last]) // (2 * (u - last))
        meet[empty] = 0
        add = empty | (meet < width)
        top[add] += 1
        at[rows[add], top[add]] = u
        begin[rows[add], top[add]] = meet[add]
    out = np.empty_like(column)
    for x in range(width - 1, -1, -1):
        last = at[rows, top]
        out[:, x] = (x - last) ** 2 + column[rows, last]
        top -= (begin[rows, top] == x) & (top > 0)
    return out


def along_columns(flags: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Squared distances along columns to the nearest flag; ``above`` and ``below`` are distances from the band's first and last row."""
    height = len(flags)
    row = np.arange(height)[:, None]
    up = np.maximum.accumulate(np.where(flags, row, -NONE), axis=0)
    down = np.minimum.accumulate(np.where(flags, row, NONE)[::-1], axis=0)[::-1]
    near = np.minimum(row - np.maximum(up, -above), np.minimum(down, height - 1 + below) - row)
    return np.minimum(near, NONE) ** 2


def _carried(marks: DataFrame, bands: tuple[int, int]) -> DataFrame:
    """``band, block, above, below``: for each band and block of columns the nearest flagged rows outside the band."""

    def sweep(key: tuple, table: pa.Table) -> pa.Table:
        first = np.full((bands[1] - bands[0] + 1, COLUMNS), NONE)
        last = np.full_like(first, -NONE)
        b, c = table["band"].to_numpy() - bands[0], table["c"].to_numpy() - key[0].as_py() * COLUMNS
        first[b, c], last[b, c] = table["first"].to_numpy(), table["last"].to_numpy()
        above, below = np.full_like(first, -NONE), np.full_like(first, NONE)
        above[1:] = np.maximum.accumulate(last, axis=0)[:-1]
        below[:-1] = np.minimum.accumulate(first[::-1], axis=0)[::-1][1:]
        ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * COLUMNS)
        blocks = pa.array(np.full(len(first), key[0].as_py()))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (above, below)]
        return pa.Table.from_arrays([pa.array(np.arange(bands[0], bands[1] + 1)), blocks, *lists], names=["band", "block", "above", "below"])

    ends = marks.groupBy("band", "c").agg(F.min("r").alias("first"), F.max("r").alias("last"))
    schema = "band long, block long, above array<long>, below array<long>"
    return ends.withColumn("block", div(F.col("c"), COLUMNS)).groupBy("block").applyInArrow(sweep, schema)


def distance_transform(cells: DataFrame, flagged: Column, size: float = 30.0, band_cells: int = BAND_CELLS) -> DataFrame:
    """``r, c, dist`` of every cell to the nearest flagged cell, null where there is none.

    Cells need not fill a rectangle: distances run across missing cells.
    """
    flag = F.coalesce(flagged, F.lit(False)).cast("int").alias("flag")
    cells = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), flag)
    facts = cells.agg(*[f(x) for x in ("r", "c") for f in (F.min, F.max)], F.max("flag")).first()
    if not facts[4]:
        return cells.select("r", "c", F.lit(None).cast("double").alias("dist"))
    c0, width = facts[2], facts[3] - facts[2] + 1
    height = max(1, band_cells // width)
    bands = (facts[0] // height, facts[1] // height)
    marks = cells.filter("flag = 1").select("r", "c", div(F.col("r"), height).alias("band"))
    carried = cut_lineage(_carried(marks, bands))

    def kernel(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"r": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        r0 = key[0].as_py() * height
        r, c, layers = _unpacked(left, ["flag"])
        flags = np.zeros((height, width), bool)
        flags[r - r0, c - c0] = layers["flag"].to_numpy() == 1
        above, below = np.full(width, NONE), np.full(width, NONE)
        for block, up, down in zip(right["block"].to_pylist(), right["above"], right["below"]):
            lo, hi = max(block * COLUMNS - c0, 0), min((block + 1) * COLUMNS - c0, width)
            part = slice(lo - (block * COLUMNS - c0), hi - (block * COLUMNS - c0))
            above[lo:hi] = r0 - up.values.to_numpy()[part]
            below[lo:hi] = down.values.to_numpy()[part] - (r0 + height - 1)
        squared = envelope(along_columns(flags, above, below))[r - r0, c - c0]
        return pa.Table.from_arrays([pa.array(r), pa.array(c), pa.array(size * np.sqrt(squared), mask=squared >= FAR)], names=["r", "c", "dist"])

    packed = _packed(cells, ["flag"]).withColumn("band", div(F.col("r"), height))
    packed = packed.repartition(shuffle_partitions(cells.sparkSession), "band")
    return packed.groupBy("band").cogroup(carried.groupBy("band")).applyInArrow(kernel, "r long, c long, dist double")
