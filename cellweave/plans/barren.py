"""Split barren cells by kind, one year or a chain of years.

A year reaches four cells: one for the majority filter, three for growing the
natural class and for the distance to anthropogenic cells. A chain reaches the
sum over its years, still little beside a tile, so the whole chain runs inside
one shuffle and writes nothing in between.

Only barren cells change. So only blocks of cells that hold one, and the blocks
around them, go through the shuffle; all other cells pass from the scan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.operators.neighbourhood import reach
from cellweave.operators.tiles import Grid, any_within, commonest, square, tile_map
from cellweave.session import cut_lineage, div

NATURAL, ANTHROPOGENIC = 31, 32
FILTER, GROWTH = 1, 3
NEAR, SIZE = 100.0, 30.0
REACH = max(FILTER + GROWTH, reach(NEAR, SIZE))
TILE = 512
#: Side of the blocks that are looked through for barren cells, and how many of them are marked at most.
BLOCK, MARKED = 64, 200_000


def _near_shape() -> list[int]:
    """Cells closer than the limit, as a half-width per row."""
    n = reach(NEAR, SIZE)
    cells = [[w for w in range(n + 1) if SIZE * SIZE * (d * d + w * w) < NEAR * NEAR] for d in range(-n, n + 1)]
    return [max(ws) for ws in cells]


def _likely(ref: Grid, table: dict) -> Grid:
    """Likeliest kind of barren by reference code; unlisted codes stay."""
    values, valid = ref[0].copy(), ref[1].copy()
    for code, kind in table.items():
        at = ref[0] == code
        if kind is None:
            valid &= ~at
        else:
            values[at] = kind
    return values, valid


def split_year(current: Grid, ref: Grid, schema: str) -> Grid:
    """The barren rule on dense grids.

    A barren cell keeps the kind of its reference cell; elsewhere it is
    anthropogenic near an anthropogenic reference cell, and of the likeliest
    kind, smoothed and with the natural kind grown, otherwise.
    """
    barren = current[1] & (current[0] == NATURAL)
    if not barren.any():
        return current
    known = ref[1] & ((ref[0] == NATURAL) | (ref[0] == ANTHROPOGENIC))
    near = any_within(ref[1] & (ref[0] == ANTHROPOGENIC), _near_shape())
    table = codes.BARREN_FROM_1992 if schema == "1992" else codes.BARREN_FROM_STANDARD
    smooth, smooth_ok = commonest(_likely(ref, table), FILTER)
    grown = any_within(smooth_ok & (smooth == NATURAL), square(GROWTH))
    kind = np.where(grown, NATURAL, smooth)
    kind = np.where(known, ref[0], np.where(near, ANTHROPOGENIC, kind))
    kind_ok = ref[1] & (known | near | grown | smooth_ok)
    return np.where(barren, kind, current[0]), np.where(barren, kind_ok, current[1])


def barren_chain(
    stack: DataFrame,
    years: list[int],
    first_ref: str = "lc_1992",
    layer: str = "lc_{}",
    out: str = "b_{}",
    existing: tuple[int, ...] = (),
    schema: str = "1992",
    tile: int = TILE,
) -> DataFrame:
    """Split every year, each by the result of the year before.

    The first year refers to the 1992 layer. Years in ``existing`` are already
    in the stack under their output name: kept, and still the next reference.
    """
    new = [y for y in years if y not in existing]
    used = [layer.format(y) if y in new else out.format(y) for y in years]
    inputs = list(dict.fromkeys([first_ref, *used]))

    def compute(grid):
        ref, ref_schema = grid(first_ref), schema
        for y in years:
            if y in new:
                ref = split_year(grid(layer.format(y)), ref, ref_schema)
            else:
                ref = grid(out.format(y))
            yield out.format(y), ref
            ref_schema = "standard"
        yield "_barren", grid("_barren")

    halo = REACH * max(len(new), 1)
    marked = mark_barren(stack, [layer.format(y) for y in new], REACH)
    shuffled = marked.filter("_barren is not null")
    names = {out.format(y): "int" for y in years} | {"_barren": "int"}
    solved = tile_map(shuffled, [*inputs, "_barren"], halo, tile, compute, names).filter("_barren = 1")
    rest = marked.filter("_barren is null or _barren = 0")
    passed = rest.select("r", "c", *[F.col(u).cast("int").alias(out.format(y)) for u, y in zip(used, years)])
    return solved.drop("_barren").unionByName(passed)


def mark_barren(stack: DataFrame, layers: list[str], halo: int, block: int = BLOCK, limit: int = MARKED) -> DataFrame:
    """``stack`` with ``_barren``: 1 in blocks with a barren cell, 0 in blocks their halo reaches, else null.

    ``halo`` is that of a single layer. Each layer of a chain looks at the one
    before, so a block whose last barren layer comes early is reached from less
    far. Blocks that hold a barren cell are counted; while there are more than
    ``limit``, four of them become one. So the mark is always broadcast and no
    cell is shuffled to meet it, whatever the grid.
    """
    last = F.greatest(*[F.when(F.col(x) == NATURAL, k) for k, x in enumerate(layers)], *[F.lit(None).cast("int")] * 2)
    at = {"_br": div(F.col("r"), block), "_bc": div(F.col("c"), block)}
    hold = stack.withColumn("_last", last).filter("_last is not null")
    hold = cut_lineage(hold.groupBy(*[x.alias(n) for n, x in at.items()]).agg(F.max("_last").alias("_last")))
    while hold.count() > max(limit, 1):
        block *= 2
        larger = [div(F.col(x), 2).alias(x) for x in ("_br", "_bc")]
        hold = cut_lineage(hold.groupBy(*larger).agg(F.max("_last").alias("_last")))
    n = F.ceil((F.col("_last") + 1) * halo / block)
    steps = F.explode(F.sequence(-n, n))
    around = hold.withColumn("_dr", steps).withColumn("_dc", steps)
    own = ((F.col("_dr") == 0) & (F.col("_dc") == 0)).cast("int")
    reached = around.groupBy((F.col("_br") + F.col("_dr")).alias("_br"), (F.col("_bc") + F.col("_dc")).alias("_bc"))
    blocks = F.broadcast(cut_lineage(reached.agg(F.max(own).alias("_barren"))))
    at = {"_br": div(F.col("r"), block), "_bc": div(F.col("c"), block)}
    return stack.withColumns(at).join(blocks, ["_br", "_bc"], "left").drop("_br", "_bc")


def barren_split(stack: DataFrame, current: str, ref: str, schema: str, tile: int = TILE) -> DataFrame:
    """Split class 31 of a layer by a reference layer of an earlier year, as ``r, c, v``."""
    return barren_chain(stack, [0], ref, layer=current, out="v", schema=schema, tile=tile)
