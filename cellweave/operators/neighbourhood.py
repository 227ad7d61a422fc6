"""Focal means and majority, class growth and distance to a class."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.distance import distance_transform
from cellweave.operators.tiles import (
    Shape,
    any_within,
    commonest,
    nearest,
    shape_sums,
    square,
    tile_map,
)

TILE = 256


def focal_means(df: DataFrame, layers: list[str], shapes: dict[str, Shape], tile: int = 512) -> DataFrame:
    """``r, c`` and a mean column ``<layer><shape>`` per layer and shape, NoData ignored.

    All layers and shapes share one shuffle. Layers with the same NoData cells,
    as the indicators of one grid, share their counts.
    """
    halo = max(len(s) // 2 for s in shapes.values())

    def compute(grid):
        counted = None
        for name in layers:
            values, valid = grid(name)
            sums = shape_sums(values, list(shapes.values()))
            if counted is None or not np.array_equal(counted, valid):
                counted, counts = valid, shape_sums(valid, list(shapes.values()))
            for shape, s, n in zip(shapes, sums, counts):
                yield f"{name}{shape}", (s / np.maximum(n, 1), n > 0)

    names = {f"{x}{s}": "double" for x in layers for s in shapes}
    return tile_map(df, layers, halo, tile, compute, names)


def focal_mean_square(cells: DataFrame, n: int = 1, tile: int = TILE) -> DataFrame:
    """``r, c, mean`` over a square of ``2 n + 1`` cells."""
    return focal_means(cells, ["v"], {"": square(n)}, tile).withColumnRenamed("v", "mean")


def focal_majority(cells: DataFrame, n: int = 1, tile: int = TILE) -> DataFrame:
    """``r, c, majority``: the commonest value of a square, ties to the lowest code."""

    def compute(grid):
        yield "majority", commonest(grid("v"), n)

    return tile_map(cells, ["v"], n, tile, compute, {"majority": "int"})


def expand_class(cells: DataFrame, code: int, n: int, tile: int = TILE) -> DataFrame:
    """``r, c, expanded``: one class grown by ``n`` cells in a square, over any value and NoData."""

    def compute(grid):
        values, valid = grid("v")
        near = any_within(valid & (values == code), square(n))
        yield "expanded", (np.where(near, code, values), valid | near)

    return tile_map(cells, ["v"], n, tile, compute, {"expanded": "int"})


def reach(limit: float, size: float) -> int:
    """Cells along an axis that are closer than a limit."""
    return math.ceil(limit / size) - 1


def euclid_distance(
    cells: DataFrame, code: int, limit: float | None = None, size: float = 30.0, tile: int = TILE
) -> DataFrame:
    """``r, c, dist`` to the nearest cell of a class, null from ``limit`` on.

    Short limits are looked up in tiles with a halo. One that does not fit a
    tile, and none at all, take the exact transform of the whole grid.
    """
    if limit is None or reach(limit, size) >= tile:
        far = distance_transform(cells, F.col("v") == code, size)
        return far if limit is None else far.withColumn("dist", F.when(F.col("dist") < limit, F.col("dist")))
    n = reach(limit, size)

    def compute(grid):
        values, valid = grid("v")
        squared = nearest(valid & (values == code), n)
        yield "dist", (size * np.sqrt(squared), squared * (size * size) < limit * limit)

    return tile_map(cells, ["v"], n, tile, compute, {"dist": "double"})


def within_distance(cells: DataFrame, code: int, limit: float, size: float = 30.0, tile: int = TILE) -> DataFrame:
    """``r, c, near``: whether a cell of a class is closer than ``limit``."""
    d = euclid_distance(cells, code, limit, size, tile)
    return d.select("r", "c", d["dist"].isNotNull().alias("near"))
