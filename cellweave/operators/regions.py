"""Features as cell sets: parts, buffers, holes, closing and opening, wraps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators.components import FOUR, TILE, cell_col, cell_number, cell_row, label_parts, link_parts
from cellweave.operators.runs import (
    BLOCK,
    dilate,
    disk,
    dissolve_runs,
    erode,
    in_blocks,
    intersect,
    merge_runs,
    subtract,
    to_cells,
    to_runs,
)
from cellweave.session import cut_lineage, div, lookup

PART = ["part_r", "part_c"]
SIZE = 30.0
GAP = 900.0


def metres(distance: float | str) -> float:
    """A distance given as a number of metres or as text like ``100 METERS``."""
    if isinstance(distance, (int, float)):
        return float(distance)
    number, unit = distance.split(" ")
    units = {"METERS": 1.0, "KILOMETERS": 1000.0, "FEET": 0.3048}
    if unit.upper() not in units:
        raise ValueError(f"unknown unit: {unit}")
    return float(number) * units[unit.upper()]


def explode_parts(features: DataFrame, keys: list[str] = ["feat_id"], tile: int = TILE) -> DataFrame:
    """Single parts of each feature, null cells dropped."""
    return to_cells(label_parts(to_runs(features, keys), keys, tile=tile))


def clean_clip(features: DataFrame, mask: DataFrame, keys: list[str] = ["feat_id"], tile: int = TILE) -> DataFrame:
    """Features inside a mask, split into parts; both meet as runs."""
    inside = intersect(to_runs(features, keys), to_runs(mask, []), keys)
    return to_cells(label_parts(inside, keys, tile=tile))


def clean_erase(features: DataFrame, mask: DataFrame, keys: list[str] = ["feat_id"], tile: int = TILE) -> DataFrame:
    """Features outside a mask, split into parts; both meet as runs."""
    outside = subtract(to_runs(features, keys), to_runs(mask, []), keys)
    return to_cells(label_parts(outside, keys, tile=tile))


def dissolve_parts(features: DataFrame, tile: int = TILE) -> DataFrame:
    """All features merged, then split into parts."""
    return explode_parts(features, [], tile)


def buffer_dilate(features: DataFrame, distance: float | str, size: float = SIZE, merge: bool = True) -> DataFrame:
    """Cells within a distance; ``merge`` unites overlapping features."""
    keys = [] if merge else ["feat_id"]
    return to_cells(dilate(to_runs(features, keys), metres(distance), size, keys))


def buffer_erode(features: DataFrame, distance: float | str, size: float = SIZE) -> DataFrame:
    """Cells at least a distance inside their feature."""
    keys = ["feat_id"]
    return to_cells(erode(to_runs(features, keys), metres(distance), size, keys))


def _gaps(named: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``keys, r, c0, c1, left, right``: gaps between runs of a row, and the parts ``p`` on both sides.

    Rows are looked through block by block; what is last in a block meets what
    is first in a later one.
    """
    fields = [*keys, "r", "c0", "c1", "p"]
    inner = W.partitionBy(*keys, "r", "block").orderBy("c0")
    after = F.lead(F.struct("c0", "p"))
    runs = named.select(*fields, div(F.col("c0"), block).alias("block")).withColumns(
        {"_next": after.over(inner), "_first": F.row_number().over(inner) == 1}
    )
    ends = runs.filter(F.col("_next").isNull() | F.col("_first"))
    across = W.partitionBy(*keys, "r").orderBy("c0")
    last = ends.withColumn("_then", after.over(across)).filter(F.col("_next").isNull())
    both = runs.filter(F.col("_next").isNotNull()).select(*fields, "_next")
    both = both.unionByName(last.filter(F.col("_then").isNotNull()).select(*fields, F.col("_then").alias("_next")))
    return both.select(
        *keys, "r", (F.col("c1") + 1).alias("c0"), (F.col("_next.c0") - 1).alias("c1"),
        F.col("p").alias("left"), F.col("_next.p").alias("right"),
    )


def _covered(gaps: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """``gaps`` with ``covered``: whether the rows above and below reach past both ends, so no cell of it lies open."""
    spans = named.groupBy(*keys, "r").agg(F.min("c0").alias("s0"), F.max("c1").alias("s1"))
    near = F.explode(F.array(F.lit(-1), F.lit(1))).alias("by")
    spans = spans.select(*keys, "r", "s0", "s1", near).withColumn("r", F.col("r") + F.col("by"))
    # Rows on both sides are needed: the ends they share.
    spans = spans.groupBy(*keys, "r").agg(F.max("s0").alias("s0"), F.min("s1").alias("s1"), F.count("*").alias("n"))
    covered = F.coalesce((F.col("n") == 2) & (F.col("s0") <= F.col("c0")) & (F.col("c1") <= F.col("s1")), F.lit(False))
    return gaps.join(spans, [*keys, "r"], "left").withColumn("covered", covered).drop("s0", "s1", "n")


def fill_holes(
    parts: DataFrame,
    keys: list[str],
    below_area: float | None = None,
    below_percent: float | None = None,
    size: float = SIZE,
    tile: int = TILE,
    disjoint: bool = True,
) -> DataFrame:
    """Fill the gaps contained in a part that are smaller than a threshold.

    The area is in square metres; the percentage is of the part with its gaps.

    Parts of the same keys are ``disjoint`` and do not touch, as those from
    ``label_parts``; then the gaps between all of them are labelled once. A gap
    that does not lie open is a hole of the part left of its first cell. What
    lies inside the hole, further parts and their gaps, counts to its area: the
    signed sum of the ends of its runs that border on its part. So nothing is
    followed from part to gap to part, however deep they nest.
    """
    if below_area is not None and below_area <= size * size:
        return parts  # no gap is smaller than a cell
    parts = cut_lineage(parts.select(*keys, cell_number(F.col("part_r"), F.col("part_c")).alias("p"), "r", "c0", "c1"))
    named, own = parts, [*keys]
    if not disjoint:
        named, own = parts.withColumn("_own", F.col("p")), [*keys, "_own"]
    gaps = link_parts(_gaps(named, own), own, FOUR, tile, ["left", "right"])
    gaps = gaps.withColumn("hole", cell_number(F.col("part_r"), F.col("part_c"))).drop("part_r", "part_c")
    gaps = cut_lineage(_covered(gaps, named, own))

    first = F.struct("r", "c0")
    sides = F.explode(
        F.array(
            F.struct(F.col("left").alias("p"), (-F.col("c0")).alias("x"), first.alias("at")),
            F.struct(F.col("right").alias("p"), (F.col("c1") + 1).alias("x"), F.lit(None).cast("struct<r:long,c0:long>").alias("at")),
        )
    )
    around = gaps.select(*own, "hole", "covered", sides.alias("s")).groupBy(*own, "hole", F.col("s.p").alias("p"))
    around = around.agg(F.sum("s.x").alias("area"), F.min("s.at").alias("at"), F.min("covered").alias("closed"))
    outer = F.min_by(F.struct("p", "area"), "at").alias("o")
    holes = around.groupBy(*own, "hole").agg(outer, F.min("closed").alias("closed")).filter("closed")
    holes = holes.select(*own, "hole", F.col("o.p").alias("p"), F.col("o.area").alias("area"))
    if below_percent is not None:
        solid = named.groupBy(*own, "p").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("solid"))
        holes = cut_lineage(holes)
        whole = holes.groupBy(*own, "p").agg(F.sum("area").alias("inside")).join(solid, [*own, "p"])
        whole = whole.select(*own, "p", (F.col("solid") + F.col("inside")).alias("outer"))
        holes = lookup(holes, whole, [*own, "p"], holes.count(), "inner")
        holes = holes.filter(F.col("area") * 100 < F.col("outer") * F.lit(below_percent))
    if below_area is not None:
        holes = holes.filter(F.col("area") * (size * size) < below_area)

    filled = lookup(gaps, holes.select(*own, "hole", "p"), [*own, "hole"], gaps.count(), "inner")
    starts, ends = F.col("left") == F.col("p"), F.col("right") == F.col("p")
    simple = filled.filter(starts & ends).select(*keys, "p", "r", "c0", "c1")
    # A row of a hole that is broken by what lies inside: from a run that begins at the part to one that ends at it.
    along = W.partitionBy(*own, "hole", "r").orderBy("c0")
    broken = filled.filter(starts != ends).withColumn("c1", F.lead("c1").over(along)).filter(starts)
    whole = parts.unionByName(simple).unionByName(broken.select(*keys, "p", "r", "c0", "c1"))
    merged = merge_runs(whole, [*keys, "p"])
    return merged.select(*keys, cell_row(F.col("p")).alias("part_r"), cell_col(F.col("p")).alias("part_c"), "r", "c0", "c1")


def _coalesce_runs(
    runs: DataFrame, distance: float, size: float, keys: list[str], group: list[str], tile: int
) -> DataFrame:
    """Closing for a positive, opening for a negative distance; parts as runs.

    ``keys`` name features, ``group`` what the merging buffer keeps apart. The
    first buffer loses gaps of less than 900 square metres, if a cell is smaller
    than that. Otherwise its parts need no names: a disk that fits into the
    buffer lies in one part of it.
    """
    if distance == 0:
        raise ValueError("the dilation distance must not be zero")
    merge = distance > 0
    first, own = (
        (dilate(dissolve_runs(runs, group), distance, size, group), group)
        if merge
        else (erode(runs, -distance, size, keys), keys)
    )
    if size * size < GAP:
        first = fill_holes(label_parts(first, own, tile=tile), own, below_area=GAP, size=size, tile=tile)
        first = first.withColumnsRenamed({"part_r": "b_r", "part_c": "b_c"})
        own = [*own, "b_r", "b_c"]
    if merge:
        closed = label_parts(erode(first, distance, size, own), own, tile=tile)
        return closed.select(*group, *PART, "r", "c0", "c1")
    return label_parts(dilate(dissolve_runs(first, group), -distance, size, group), group, tile=tile)


def coalesce_regions(features: DataFrame, distance: float | str, size: float = SIZE, tile: int = TILE) -> DataFrame:
    """Merge nearby features (distance above 0) or cut narrow places (below 0)."""
    keys = ["feat_id"]
    return to_cells(_coalesce_runs(to_runs(features, keys), metres(distance), size, keys, [], tile))


def near_links(distance: float, size: float) -> list[int]:
    """What links two cells whose buffers touch: for each difference in rows the largest difference in columns."""
    widths = dict(disk(distance, size))
    k = max(widths)
    links = [0] * (2 * k + 2)
    for a, wa in widths.items():
        for b, wb in widths.items():
            for d in (a + b - 1, a + b, a + b + 1):
                if d >= 0:
                    links[d] = max(links[d], wa + wb + 1)
    return links


def wrap_members(runs: DataFrame, distance: float, size: float, tile: int = TILE) -> DataFrame:
    """``wrap_r, wrap_c, r, c0, c1``: runs grouped by the connected buffer they lie in, which is never made.

    Runs are linked directly if their buffers touch. A wrap is named by the
    first cell of the buffer: that of its first member, moved.
    """
    k, width = disk(distance, size)[0]
    found = link_parts(runs, [], near_links(distance, size), tile)
    return found.select(
        (F.col("part_r") + k).alias("wrap_r"), (F.col("part_c") - width).alias("wrap_c"), "r", "c0", "c1"
    )


def shrink_wrap(
    features: DataFrame, distance: float | str, smooth: float = 8, size: float = SIZE, tile: int = TILE
) -> DataFrame:
    """Wrap groups of nearby features.

    Features whose buffers touch make a wrap. The members of a wrap are closed with the distance times ``smooth`` and lose
    gaps below 99 percent. All wraps run in one job keyed by wrap.
    """
    distance = metres(distance)
    if distance <= 0:
        raise ValueError("the dilation distance must be positive")
    group = ["wrap_r", "wrap_c"]
    members = cut_lineage(wrap_members(to_runs(features, []), distance, size, tile))
    closed = _coalesce_runs(members, distance * smooth, size, group, group, tile)
    # With cells so small that buffers lose gaps, the parts of a wrap may lie one over the other.
    alone = size * size >= GAP
    return to_cells(fill_holes(closed, group, below_percent=99.0, size=size, tile=tile, disjoint=alone))


def select_by_location(features: DataFrame, other: DataFrame, block: int = 1024) -> DataFrame:
    """Ids of the features that share a cell with another cell set; both meet as runs."""
    pieces = in_blocks(to_runs(other, []), block).withColumnsRenamed({"c0": "o0", "c1": "o1"})
    runs = in_blocks(to_runs(features, ["feat_id"]), block)
    met = runs.join(pieces, ["r", "block"])
    return met.filter((F.col("c0") <= F.col("o1")) & (F.col("c1") >= F.col("o0"))).select("feat_id").distinct()


def count_features(features: DataFrame) -> DataFrame:
    return features.agg(F.countDistinct("feat_id").alias("n"))


def count_selected(features: DataFrame, where) -> DataFrame:
    """Features passing a selection beside the whole set; each is reduced to one row first."""
    named = features.filter(F.col("feat_id").isNotNull())
    one = named.groupBy("feat_id").agg(F.max(F.coalesce(where, F.lit(False)).cast("int")).alias("hit"))
    return one.agg(
        F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("n_selected"), F.count(F.lit(1)).alias("n_all")
    )
