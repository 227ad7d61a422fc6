"""Tiles with a halo: one shuffle brings together all a neighbourhood needs.

A cell is sent to its own tile and to the tiles whose halo holds it, so data
grows by ``((tile + 2 * halo) / tile) ** 2`` and not by the number of neighbours.
Inside a tile the layers are dense arrays. Window functions along rows and then
columns would not do: where the extent is ragged, a row's result is also needed
at places that have no cell. A task holds the packed cells of a tile and its halo,
``(tile + 2 * halo) ** 2`` of each layer at most, and a few dense layers at once;
``tile_map`` also holds its results, ``tile_long`` hands them on one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cellweave.session import div, shuffle_partitions

KEY = ["tile_r", "tile_c"]
SEGMENT = 64  # cells packed into one record at most
Shape = list[int]  # half-width of each row, from the top row to the bottom one
Grid = tuple[np.ndarray, np.ndarray]  # values, and where they are not NoData


def packing(layers: dict[str, str], segment: int = SEGMENT) -> tuple[Callable, str]:
    """What ``mapInArrow`` needs to pack cells ``r, c`` (64 bits) and ``layers``, given with their types.

    Neighbouring cells of a row become one record ``r, c0`` with a list per layer,
    batch by batch. Unsorted input packs less and is as right.
    """

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.sort_by([("r", "ascending"), ("c", "ascending")])
            r, c = batch.column("r").to_numpy(), batch.column("c").to_numpy()
            first = (np.diff(r) != 0) | (np.diff(c) != 1) | (c[1:] % segment == 0)
            start = np.flatnonzero(np.concatenate(([True], first)))
            offsets = pa.array(np.append(start, len(r)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(x)) for x in layers]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r[start]), pa.array(c[start]), *lists], names=["r", "c0", *layers]
            )

    return pack, "r long, c0 long, " + ", ".join(f"{x} array<{t}>" for x, t in layers.items())


def _packed(df: DataFrame, layers: list[str], segment: int = SEGMENT) -> DataFrame:
    """Cells packed before the shuffle, so it moves and sorts few records."""
    cells = df.select(F.col("r").cast("long"), F.col("c").cast("long"), *layers)
    return cells.mapInArrow(*packing({x: df.schema[x].dataType.simpleString() for x in layers}, segment))


def _unpacked(table: pa.Table, layers: list[str]):
    """Rows, columns and layer values of the cells in packed records."""
    size = pc.list_value_length(table[layers[0]]).to_numpy()
    before = np.repeat(np.cumsum(size) - size, size)
    c = np.repeat(table["c0"].to_numpy(), size) + np.arange(size.sum()) - before
    return np.repeat(table["r"].to_numpy(), size), c, {x: pc.list_flatten(table[x]) for x in layers}


def with_halo(packed: DataFrame, layers: list[str], halo: int, tile: int) -> DataFrame:
    """Copies of packed cells for every tile within ``halo`` cells, hashed by tile.

    The partition count is given, not left to adaptive coalescing: that goes by
    bytes, and neighbourhood work is heavy for its bytes.
    """
    if halo >= tile:
        raise ValueError("the tile must be larger than its halo")

    def tiles(first, last):
        low = F.when(first >= 0, F.greatest(div(first - halo, tile), F.lit(0)))
        low = low.otherwise(F.raise_error(F.lit("row and column numbers start at 0")))
        return F.explode(F.sequence(low.cast("long"), div(last + halo, tile)))

    r, c0 = F.col("r"), F.col("c0")
    packed = packed.withColumn("tile_r", tiles(r, r))
    packed = packed.withColumn("tile_c", tiles(c0, c0 + F.size(layers[0]) - 1))
    return packed.repartition(shuffle_partitions(packed.sparkSession), *KEY)


def circle(radius: int) -> Shape:
    return [math.isqrt(radius * radius - d * d) for d in range(-radius, radius + 1)]


def square(n: int) -> Shape:
    return [n] * (2 * n + 1)


def shape_sums(dense: np.ndarray, shapes: list[Shape]) -> list[np.ndarray]:
    """Sums over each shape at every cell, from one set of row prefix sums."""
    height, width = dense.shape
    pad = max(max(s) for s in shapes)
    largest = int(max(abs(int(dense.max())), abs(int(dense.min()))))
    number = np.int32 if largest * dense.size < 2**31 else np.int64
    prefix = np.zeros((height, width + 2 * pad + 1), dtype=number)
    np.cumsum(dense, axis=1, out=prefix[:, pad + 1 : pad + 1 + width])
    prefix[:, pad + 1 + width :] = prefix[:, pad + width, None]
    sums = []
    for shape in shapes:
        k = len(shape) // 2
        by_width = {
            w: prefix[:, pad + w + 1 : pad + w + 1 + width] - prefix[:, pad - w : pad - w + width]
            for w in set(shape)
        }
        out = np.zeros((height, width), dtype=number)
        for d, w in zip(range(-k, k + 1), shape):
            lo, hi = max(0, -d), min(height, height - d)
            if lo < hi:
                out[lo:hi] += by_width[w][lo + d : hi + d]
        sums.append(out)
    return sums


def any_within(flags: np.ndarray, shape: Shape) -> np.ndarray:
    return shape_sums(flags, [shape])[0] > 0


def commonest(grid: Grid, n: int) -> Grid:
    """Commonest value of a square, NoData ignored, ties to the lowest."""
    values, valid = grid
    best, most = np.zeros_like(values), np.zeros(values.shape, dtype=np.int64)
    for code in np.unique(values[valid]):
        count = shape_sums(valid & (values == code), [square(n)])[0]
        ahead = count > most
        best[ahead], most[ahead] = code, count[ahead]
    return best, most > 0


def nearest(flags: np.ndarray, n: int) -> np.ndarray:
    """Squared distance in cells to the nearest flag, right up to ``n`` rows away."""
    height, width = flags.shape
    far = 1 << 30
    at = np.arange(width)
    left = np.maximum.accumulate(np.where(flags, at, -far), axis=1)
    right = np.minimum.accumulate(np.where(flags, at, far)[:, ::-1], axis=1)[:, ::-1]
    in_row = np.minimum(at - left, right - at) ** 2
    out = in_row.copy()
    for d in range(-n, n + 1):
        lo, hi = max(0, -d), min(height, height - d)
        if lo < hi:
            np.minimum(out[lo:hi], in_row[lo + d : hi + d] + d * d, out=out[lo:hi])
    return out


def tile_map(
    df: DataFrame,
    layers: list[str],
    halo: int,
    tile: int,
    compute: Callable[[Callable[[str], Grid]], Iterator[tuple[str, Grid]]],
    out: dict[str, str],
) -> DataFrame:
    """Run ``compute`` on every tile; ``out`` names its results and their types.

    ``compute`` gets a function from a layer's name to its dense grid and yields
    named results in the order of ``out``. Of each result only the tile's own
    cells are kept, so a tile never holds all layers dense at once.
    """

    def kernel(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        opened = _open_tile(key, table, layers, tile)
        if opened is None:
            return empty
        r, c, pick, dense = opened
        cols = [
            pa.array(values[pick], mask=~valid[pick]).cast(empty.schema.field(name).type)
            for name, (values, valid) in compute(dense)
        ]
        return pa.Table.from_arrays([pa.array(r), pa.array(c), *cols], names=names)

    check_whole_numbers(df, layers)
    types = {"int": pa.int32(), "double": pa.float64()}
    names = ["r", "c", *out]
    empty = pa.schema(
        [("r", pa.int64()), ("c", pa.int64()), *[(n, types[t]) for n, t in out.items()]]
    ).empty_table()
    schema = "r long, c long, " + ", ".join(f"{n} {t}" for n, t in out.items())
    tiled = with_halo(_packed(df, layers), layers, halo, tile)
    return tiled.groupBy(*KEY).applyInArrow(kernel, schema)


def tile_long(
    packed: DataFrame,
    layers: list[str],
    halo: int,
    tile: int,
    compute: Callable[[Callable[[str], Grid]], Iterator[tuple[str, np.ndarray]]],
    keep: str | None = None,
) -> DataFrame:
    """Run ``compute`` on every tile of cells that ``packing`` packed; ``layer, r, c, v`` of its whole-number results.

    Results are handed on one layer at a time, so a tile holds one of them.
    ``keep`` names a layer whose cells are returned only where it is not 0.
    """

    def kernel(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _open_tile(key, pa.Table.from_batches(batches), layers, tile)
        if opened is None:
            return
        r, c, pick, dense = opened
        if keep is not None:
            values, valid = dense(keep)
            kept = (values[pick] != 0) & valid[pick]
            r, c, pick = r[kept], c[kept], (pick[0][kept], pick[1][kept])
        places = [pa.array(r), pa.array(c)]
        for name, values in compute(dense):
            named = pa.array([name]).take(pa.array(np.zeros(len(r), np.int32)))
            found = pa.array(values[pick].astype(np.int32))
            yield pa.RecordBatch.from_arrays([named, *places, found], names=["layer", "r", "c", "v"])

    tiled = with_halo(packed, layers, halo, tile)
    return tiled.groupBy(*KEY).applyInArrow(kernel, "layer string, r long, c long, v int")


def check_whole_numbers(df: DataFrame, layers: list[str]) -> None:
    for name in layers:
        if not isinstance(df.schema[name].dataType, IntegralType):
            raise TypeError(f"layer {name} must hold whole numbers")


def _open_tile(key: tuple[pa.Scalar, ...], table: pa.Table, layers: list[str], tile: int):
    """Rows and columns of a tile's own cells, their places in dense grids, and a maker of those; none without cells."""
    r, c, stored = _unpacked(table, layers)
    own = (r // tile == key[0].as_py()) & (c // tile == key[1].as_py())
    if not own.any():
        return None
    r0, c0 = r.min(), c.min()
    size = (int(r.max() - r0) + 1, int(c.max() - c0) + 1)
    at = (r - r0, c - c0)

    def dense(name: str) -> Grid:
        values, valid = np.zeros(size, np.int64), np.zeros(size, bool)
        values[at] = stored[name].fill_null(0).to_numpy()
        valid[at] = stored[name].is_valid().to_numpy()
        return values, valid

    return r[own], c[own], (at[0][own], at[1][own]), dense
