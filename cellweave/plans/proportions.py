"""Proportional cover: focal means of indicator and percentage layers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.functions.columns import indicator, set_null
from cellweave.model import GridSpec
from cellweave.operators.overlay import polygon_spans
from cellweave.operators.quadtree import flags
from cellweave.operators.runs import dilate, merge_runs, to_runs
from cellweave.operators.tiles import check_whole_numbers, circle, packing, shape_sums, square, tile_long

SHAPES = {"1": square(1), "10": circle(10), "100": circle(100)}


def indicator_stack(stack: DataFrame, cover: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The six indicator layers of a class layer, a column each."""
    clean = set_null(cover, codes.CLASS_NODATA)
    return stack.select("r", "c", *[indicator(clean, k).alias(k) for k in codes.INDICATORS], *keep)


def _layers(cover: str, impervious: str | None, canopy: str | None, canopy_nodata: int) -> dict:
    layers = {k: indicator(set_null(cover, codes.CLASS_NODATA), k) for k in codes.INDICATORS}
    if impervious:
        layers["impsur"] = set_null(impervious, codes.IMPERVIOUS_NODATA)
    if canopy:
        layers["canopy"] = set_null(canopy, canopy_nodata)
    return layers


def study_runs(
    area: DataFrame | None = None, edges: DataFrame | None = None, spec: GridSpec = GridSpec(), buffer: float = 0.0
) -> DataFrame:
    """The study area, a grid or a polygon, grown by a buffer, as runs."""
    runs = to_runs(area, []) if edges is None else merge_runs(polygon_spans(edges, spec), [])
    return dilate(runs, buffer, spec.size, []) if buffer else runs


def _packed_inputs(cells: DataFrame, names: list[str], sets: dict[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    """Cells marked by ``sets`` and packed for tiles in one pass, and the layers they hold.

    Cells outside the set ``_known`` are NoData; ``_kept`` becomes a layer.
    """
    check_whole_numbers(cells, names)
    types = {n: cells.schema[n].dataType.simpleString() for n in names}
    pack, schema = packing(types | ({"_kept": "int"} if "_kept" in sets else {}))

    def known(batches):
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            if "_known" in columns:
                held = columns.pop("_known")
                columns |= {n: pc.if_else(held, columns[n], pa.scalar(None, columns[n].type)) for n in names}
            if "_kept" in columns:
                columns["_kept"] = columns["_kept"].cast(pa.int32())
            yield pa.RecordBatch.from_pydict(columns)

    every = [*names, *(["_kept"] if "_kept" in sets else [])]
    if not sets:
        return cells.mapInArrow(pack, schema), every
    return flags(cells, sets, (lambda batches: pack(known(batches)), schema)), every


def lc_proportions_years(
    stack: DataFrame,
    years: dict[int, tuple[str, str | None, str | None]],
    mask: DataFrame | None = None,
    area: DataFrame | None = None,
    edges: DataFrame | None = None,
    spec: GridSpec = GridSpec(),
    buffer: float = 0.0,
    canopy_nodata: int = codes.CANOPY_NODATA,
    shapes: dict = SHAPES,
    tile: int = 512,
) -> DataFrame:
    """Scaled means ``year, name, r, c, v`` of every year, layer and neighbourhood.

    ``years`` gives the class layer and, where there is one, the impervious and
    the canopy layer of each year. Cells outside the study area, a grid or a
    polygon grown by the buffer, are NoData: they do not count, but keep a mean
    of their neighbours. The mask goes through the tiles as a layer and drops
    cells there; all years, layers and neighbourhoods share one shuffle.
    """
    layers = {
        f"y{year}_{k}": (k, expr)
        for year, (cover, impervious, canopy) in years.items()
        for k, expr in _layers(cover, impervious, canopy, canopy_nodata).items()
    }
    sets = {}
    if area is not None or edges is not None:
        sets["_known"] = study_runs(area, edges, spec, buffer)
    if mask is not None:
        sets["_kept"] = to_runs(mask, [])
    place = [F.col(x).cast("long").alias(x) for x in ("r", "c")]
    inputs = stack.select(*place, *[e.alias(n) for n, (_, e) in layers.items()])
    names, sizes = list(layers), list(shapes.values())
    scales = {n: 100 if k in codes.PERCENT_LAYERS else 10000 for n, (k, _) in layers.items()}
    tags = list(shapes)

    def compute(grid):
        counted = None
        for name in names:
            values, valid = grid(name)
            sums = shape_sums(values, sizes)
            if counted is None or not np.array_equal(counted, valid):
                counted, counts = valid, shape_sums(valid, sizes)
            for tag, total, n in zip(tags, sums, counts):
                mean = np.where(n > 0, total / np.maximum(n, 1), 0.0)  # a mean of nothing is 0
                yield f"{name}{tag}", np.floor(mean * scales[name] + 0.5)

    halo = max(len(s) // 2 for s in sizes)
    packed, every = _packed_inputs(inputs, names, sets)
    long = tile_long(packed, every, halo, tile, compute, "_kept" if mask is not None else None)
    return long.select(
        F.substring("layer", 2, 4).cast("int").alias("year"), F.expr("substring(layer, 7)").alias("name"), "r", "c", "v"
    )


def lc_proportions(
    stack: DataFrame,
    cover: str,
    mask: DataFrame | None = None,
    impervious: str | None = "impsur",
    canopy: str | None = "canopy",
    **options,
) -> DataFrame:
    """Scaled means ``name, r, c, v`` of one year."""
    return lc_proportions_years(stack, {1000: (cover, impervious, canopy)}, mask, **options).drop("year")
