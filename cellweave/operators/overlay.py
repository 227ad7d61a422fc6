"""Overlay, masks, clipping, alignment and overviews."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cellweave.functions.columns import plain
from cellweave.model import CELLS, GridSpec
from cellweave.operators.quadtree import COVER_BYTES, inside
from cellweave.operators.runs import to_runs
from cellweave.operators.tiles import SEGMENT as PACKED
from cellweave.operators.tiles import _packed, _unpacked
from cellweave.session import cut_lineage, div
from cellweave.sources.blocklog import pack_blocks

RC = ["r", "c"]


def overlay_join(layers: dict[str, DataFrame], how: str = "inner") -> DataFrame:
    """Join co-registered grids into a stack, a column per layer.

    Every input is hashed on the same keys, so each is shuffled once however
    many layers there are.
    """
    frames = [df.select(*RC, F.col("v").alias(name)) for name, df in layers.items()]
    return reduce(lambda a, b: a.join(b, RC, how), frames)


def stack_layers(cells: DataFrame, names: list[str], block: int = 256) -> DataFrame:
    """Long cells to a stack in a single shuffle, of packed records: a block of all layers meets in one call.

    A cell of any of the layers is in the stack, null where a layer lacks it. Of
    repeated cells the largest value counts.
    """
    picked = cells.filter(F.col("layer").isin(names)).withColumn("year", F.lit(None).cast("int"))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        held = np.zeros(block * block, bool)
        columns = {name: (np.zeros(block * block, np.int64), np.zeros(block * block, bool)) for name in names}
        for i, name in enumerate(table["layer"].to_pylist()):
            at = np.frombuffer(table["at"][i].as_py(), np.int32)
            found = table["vals"][i].values
            known = found.is_valid().to_numpy(zero_copy_only=False)
            held[at] = True
            values, valid = columns[name]
            at, found = at[known], found.drop_null().to_numpy().astype(np.int64)
            values[at] = np.where(valid[at], values[at], np.iinfo(np.int64).min)
            np.maximum.at(values, at, found)
            valid[at] = True
        at = np.flatnonzero(held)
        places = [pa.array(key[0].as_py() * block + at // block), pa.array(key[1].as_py() * block + at % block)]
        stacked = [pa.array(values[at].astype(np.int32), mask=~valid[at]) for values, valid in columns.values()]
        return pa.Table.from_arrays([*places, *stacked], names=["r", "c", *names])

    packed = pack_blocks(picked, block).groupBy("br", "bc")
    return packed.applyInArrow(meet, "r long, c long, " + ", ".join(f"`{n}` int" for n in names))


def extent_clip(cells: DataFrame, r0: int = 0, r1: int | None = None, c0: int = 0, c1: int | None = None) -> DataFrame:
    """Cells inside a rectangle, open where no bound is given; the filter reaches the scan."""
    within = (F.col("r") >= r0) & (F.col("c") >= c0)
    for name, bound in (("r", r1), ("c", c1)):
        within = within if bound is None else within & (F.col(name) <= bound)
    return cells.filter(within)


def polygon_edges(points: DataFrame) -> DataFrame:
    """Edges ``ring, x1, y1, x2, y2`` of closed rings given as ``ring, seq, x, y``."""
    ring = W.partitionBy("ring").orderBy("seq")
    ends = {"x2": F.lead("x").over(ring), "y2": F.lead("y").over(ring)}
    edges = points.withColumns(ends).filter(F.col("x2").isNotNull())
    return edges.select("ring", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def polygon_spans(edges: DataFrame, spec: GridSpec, band: int = 4096) -> DataFrame:
    """Runs ``r, c0, c1`` of the cells whose centre lies inside a polygon.

    ``edges`` has ``x1, y1, x2, y2``, all rings together. Each edge gives the
    points where it crosses the centre lines of grid rows; sorted along a row
    they pair up into inside spans (even-odd rule). Edges are cut into bands
    of rows first and spread by band and edge, so neither a tall edge nor a
    crowded band falls to one task.
    """
    a, b = spec.row(F.col("y1")), spec.row(F.col("y2"))
    # Row r is crossed when its centre r + .5 lies from the lower to below the higher end.
    first = F.ceil(F.least(a, b) - 0.5).cast("long")
    last = (F.ceil(F.greatest(a, b) - 0.5) - 1).cast("long")
    cut = (
        edges.select("x1", "y1", "x2", "y2", first.alias("ra"), last.alias("rb"))
        .filter("ra <= rb")
        .withColumn("band", F.explode(F.sequence(div(F.col("ra"), band), div(F.col("rb"), band))))
        .repartition("band", "x1", "y1")
    )
    rows = cut.withColumn(
        "r",
        F.explode(
            F.sequence(
                F.greatest("ra", F.col("band") * band),
                F.least("rb", F.col("band") * band + (band - 1)),
            )
        ),
    )
    y = spec.y(F.col("r"))
    x = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    w = W.partitionBy("r").orderBy("x")
    spans = (
        rows.select("r", x.alias("x"))
        .select("r", "x", F.lead("x").over(w).alias("x_next"), F.row_number().over(w).alias("i"))
        .filter((F.col("i") % 2 == 1) & F.col("x_next").isNotNull())
    )
    # A centre is inside when x <= centre < x_next.
    c0 = F.ceil((F.col("x") - spec.x0) / spec.size - 0.5).cast("long")
    c1 = (F.ceil((F.col("x_next") - spec.x0) / spec.size - 0.5) - 1).cast("long")
    return spans.select("r", c0.alias("c0"), c1.alias("c1")).filter("c0 <= c1")


def spans_semi(cells: DataFrame, spans: DataFrame, limit: int = COVER_BYTES) -> DataFrame:
    """Cells lying in any of some runs, by a quadtree cover that is broadcast up to ``limit`` bytes."""
    return inside(cells, spans, limit=limit)


def spans_flag(cells: DataFrame, spans: DataFrame, name: str, limit: int = COVER_BYTES) -> DataFrame:
    """``cells`` with a column that tells whether they lie in any of some runs."""
    return inside(cells, spans, name, limit)


def extract_by_mask(cells: DataFrame, mask: DataFrame, limit: int = COVER_BYTES) -> DataFrame:
    """Cells inside a mask grid, which is turned into runs first."""
    return spans_semi(cells, to_runs(mask, []), limit)


def polygon_mask(cells: DataFrame, edges: DataFrame, spec: GridSpec) -> DataFrame:
    """Cells whose centre lies inside a polygon."""
    return spans_semi(cells, polygon_spans(edges, spec))


def clip_layer(
    cells: DataFrame,
    template: DataFrame | None = None,
    edges: DataFrame | None = None,
    spec: GridSpec = GridSpec(),
) -> DataFrame:
    """Mask to a template grid, or clip to a polygon; the template wins."""
    if template is not None:
        return extract_by_mask(cells, template)
    return cells if edges is None else polygon_mask(cells, edges, spec)


def align_to_template(
    cells: DataFrame, spec: GridSpec, template: DataFrame, template_spec: GridSpec
) -> DataFrame:
    """Values at the centres of the template's cells.

    Equal specs copy. Different coordinate systems are an error: no datum or
    projection mathematics happens here.
    """
    if spec.crs != template_spec.crs:
        raise ValueError(f"coordinate systems differ: {spec.crs} and {template_spec.crs}")
    if spec == template_spec:
        return cells
    return gather(cells, spec, template, template_spec)


#: Side of the squares of source cells that meet the template's cells over them.
SQUARE = 256


def gather(cells: DataFrame, spec: GridSpec, template: DataFrame, template_spec: GridSpec, square: int = SQUARE) -> DataFrame:
    """Values of the source cells below the centres of the template's cells, null where there is none.

    Rows map to rows and columns to columns, so a run of template cells over one
    square of source cells travels as one record, and source cells travel packed:
    each side is shuffled once, by square, and no cell on its own.
    """

    def source_of(r, c):
        sr = np.floor(spec.row(template_spec.y(r))).astype(np.int64)
        return sr, np.floor((template_spec.x(c) - spec.x0) / spec.size).astype(np.int64)

    def runs(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            r, c = (batch.column(x).to_numpy() for x in ("r", "c"))
            order = np.lexsort((c, r))
            r, c = r[order], c[order]
            sr, sc = source_of(r, c)
            at = np.stack([r, sr // square, sc // square])
            start = np.flatnonzero(np.append(True, (np.diff(at, axis=1) != 0).any(axis=0) | (np.diff(c) != 1)))
            n = np.diff(np.append(start, len(r)))
            cols = [at[1, start], at[2, start], r[start], c[start], n]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["sr", "sc", "r", "c", "n"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        n = left["n"].to_numpy()
        r = np.repeat(left["r"].to_numpy(), n)
        c = np.repeat(left["c"].to_numpy(), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        values = pa.nulls(len(r), empty.schema.field("v").type)
        if right.num_rows:
            sr, sc, stored = _unpacked(right, ["v"])
            place = np.full((square, square), -1)
            place[sr % square, sc % square] = np.arange(len(sr))
            wr, wc = source_of(r, c)
            found = place[wr % square, wc % square]
            values = stored["v"].take(pa.array(found, mask=found < 0))
            values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return pa.Table.from_arrays([pa.array(r), pa.array(c), values], names=["r", "c", "v"])

    if square % PACKED:
        raise ValueError(f"a square has to be a multiple of {PACKED} cells wide")
    kind = cells.schema["v"].dataType
    empty = to_arrow_schema(T.StructType([CELLS["r"], CELLS["c"], T.StructField("v", kind)])).empty_table()
    wanted = template.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    wanted = wanted.mapInArrow(runs, "sr long, sc long, r long, c long, n long")
    packed = _packed(cells, ["v"]).select(div(F.col("r"), square).alias("sr"), div(F.col("c0"), square).alias("sc"), "r", "c0", "v")
    left, right = (x.groupBy("sr", "sc") for x in (wanted, packed))
    return left.cogroup(right).applyInArrow(meet, f"r long, c long, v {kind.simpleString()}")


def pyramid_level(cells: DataFrame, factor: int) -> DataFrame:
    """Reduced-resolution overview: the commonest class, ties to the lowest code; NoData has no say."""
    r, c = div(F.col("r"), factor).alias("r"), div(F.col("c"), factor).alias("c")
    counts = cells.groupBy(r, c, "v").agg(F.count("v").alias("n"))
    # One long holds the count above and the code, turned round, below: the largest wins.
    top = 1 << 31
    best = F.max(F.when(F.col("n") > 0, F.col("n") * (2 * top) + (top - F.col("v"))))
    return counts.groupBy("r", "c").agg(best.alias("_best")).select(
        "r", "c", (top - F.pmod("_best", F.lit(2 * top))).cast(cells.schema["v"].dataType).alias("v")
    )


def pyramid_levels(cells: DataFrame, levels: int, side_bits: int = 10) -> DataFrame:
    """``level, r, c, v``: overviews of every level up to ``levels``, each of half the resolution of the one before.

    A level's cell has the commonest class of the cells below it, as
    ``pyramid_level`` does, from the histogram of four cells of the level below:
    cells are read and shuffled once, packed, by squares of ``2 ** side_bits``.
    Levels above a square go on from the histograms of whole squares.
    """
    low = min(levels, side_bits)
    schema = "level int, r long, c long, v int, n long"

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        r, c, stored = _unpacked(table, ["v"])
        side = 1 << low
        r0, c0 = key[0].as_py() * side, key[1].as_py() * side
        valid = stored["v"].is_valid().to_numpy()
        values = stored["v"].fill_null(0).to_numpy()
        held = np.zeros((side, side), bool)
        held[r - r0, c - c0] = True
        best = [(np.zeros((side >> k, side >> k), np.int64), np.zeros((side >> k, side >> k), np.int64)) for k in range(1, low + 1)]
        whole = []
        for code in np.unique(values[valid]):  # from the lowest code: ties stay with it
            count = np.zeros((side, side), np.int64)
            at = valid & (values == code)
            count[r[at] - r0, c[at] - c0] = 1
            for value, most in best:
                count = _fours(count)
                ahead = count > most
                value[ahead], most[ahead] = code, count[ahead]
            whole.append((code, int(count.sum())))
        parts = []
        for k, (value, most) in enumerate(best, 1):
            held = _fours(held) > 0
            i, j = np.nonzero(held)
            v = pa.array(value[i, j], pa.int32(), mask=most[i, j] == 0)
            parts.append((np.full(len(i), k), (r0 >> k) + i, (c0 >> k) + j, v, np.full(len(i), -1)))
        if low < levels:
            there = np.full(len(whole) + 1, 0)
            v = pa.array([None, *[code for code, _ in whole]], pa.int32())
            parts.append((there, there + key[0].as_py(), there + key[1].as_py(), v, np.array([0, *[n for _, n in whole]])))
        columns = [np.concatenate(x) for x in zip(*[(a, b, d, f) for a, b, d, _, f in parts])]
        vs = pa.chunked_array([p[3] for p in parts])
        return pa.Table.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1]), pa.array(columns[2]), vs, pa.array(columns[3])],
            names=["level", "r", "c", "v", "n"],
        )

    packed = _packed(cells.withColumn("v", F.col("v").cast("int")), ["v"], min(PACKED, 1 << low))
    squares = packed.withColumns({"sr": div(F.col("r"), 1 << low), "sc": div(F.col("c0"), 1 << low)})
    found = squares.groupBy("sr", "sc").applyInArrow(kernel, schema)
    if low == levels:
        return found.drop("n")
    found = cut_lineage(found)
    out = found.filter("n < 0").drop("n")
    hist = found.filter("n >= 0").select("r", "c", "v", "n")
    for level in range(low + 1, levels + 1):
        hist = cut_lineage(hist.groupBy(div(F.col("r"), 2).alias("r"), div(F.col("c"), 2).alias("c"), "v").agg(F.sum("n").alias("n")))
        best = F.max_by("v", F.when(F.col("n") > 0, F.struct("n", -F.col("v"))))
        modes = hist.groupBy("r", "c").agg(best.alias("v"))
        out = out.unionByName(modes.select(F.lit(level).alias("level"), "r", "c", "v"))
    return out


def _fours(grid: np.ndarray) -> np.ndarray:
    """Sums of squares of two by two."""
    n = len(grid) // 2
    return grid.reshape(n, 2, n, 2).sum(axis=(1, 3), dtype=np.int64)


def extent_rect(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """``xmin ymin xmax ymax`` of the extent."""
    xmin, xmax = spec.x0 + F.min("c") * spec.size, spec.x0 + (F.max("c") + 1) * spec.size
    near, far = F.min("r") * spec.size, (F.max("r") + 1) * spec.size
    ymin, ymax = (spec.y0 - far, spec.y0 - near) if spec.north_up else (spec.y0 + near, spec.y0 + far)
    return cells.agg(F.concat_ws(" ", *map(plain, (xmin, ymin, xmax, ymax))).alias("rect"))
