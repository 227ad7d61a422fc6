"""Connected parts of run sets, and components of graphs.

Runs are labelled inside tiles first. Then tiles are united level by level, and
only the runs on outer borders are carried on, so parts are known after a fixed
number of rounds. Graphs without a place on a grid are solved by alternating
the large-star and small-star steps of Kiveris et al., "Connected Components in
MapReduce and Beyond" (SoCC 2014), after their edges are contracted batch by
batch. Each round is written to the shared folder, and the round before is removed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from cellweave.session import cut_lineage, div, lookup, remove_step, shuffle_partitions, write_step

#: Also the side of the squares whose smaller tiles share a call of a kernel.
TILE = 1024
#: Squares that are united in each direction at a level, and runs on borders that are few enough to be united at once.
FAN, ALONE = 4, 100_000
# A cell number orders cells by row, then column; columns span 29 bits.
BITS, SHIFT = 29, 1 << 28


def cell_number(r, c):
    return F.shiftleft(r, BITS) + c + SHIFT


def cell_row(number):
    return F.shiftright(number, BITS)


def cell_col(number):
    return number.bitwiseAND((1 << BITS) - 1) - SHIFT


#: What links the cells of a part: for each difference in rows the largest difference in columns.
EIGHT, FOUR = (1, 1), (1, 0)


def _touching(feature: np.ndarray, r: np.ndarray, c0: np.ndarray, c1: np.ndarray, link: Sequence[int]):
    """Index pairs of runs of one feature that are linked.

    Runs are sorted by feature, row and column. Rows are laid end to end, blank
    rows after each feature, so neighbours differ by the width of a row.
    """
    most = max(link)
    base = c0.min() - most - 1
    wide = int(c1.max() - base) + most + 2
    line = feature * (int(r.max() - r.min()) + len(link)) + (r - r.min())
    starts, ends = line * wide + (c0 - base), line * wide + (c1 - base)
    beside = np.flatnonzero((np.diff(line) == 0) & (starts[1:] - ends[:-1] <= link[0]))
    pairs = [(beside, beside + 1)]
    for d, reach in enumerate(link[1:], 1):
        lo = np.searchsorted(ends, starts + d * wide - reach, side="left")
        hi = np.searchsorted(starts, ends + d * wide + reach, side="right")
        n = np.maximum(hi - lo, 0)
        pairs.append((np.repeat(np.arange(len(r)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)))
    return tuple(np.concatenate(x) for x in zip(*pairs))


def _smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of ``n`` items."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root == root[root]).all():
            root = root[root]


def _label_tiles(runs: DataFrame, keys: list[str], link: Sequence[int], tile: int, keep: Sequence[str] = ()) -> DataFrame:
    """Runs cut at tile borders, with the first cell of their part of the tile.

    All features of a tile are labelled by one call, and so are all tiles of a
    square if they are small: many small features or tiles cost no more than a
    large one.
    """
    edge = F.col("tile_c") * tile
    pieces = (
        runs.withColumn("_c0", F.col("c0"))
        .withColumn("tile_r", div(F.col("r"), tile))
        .withColumn("tile_c", F.explode(F.sequence(div(F.col("c0"), tile), div(F.col("c1"), tile))))
        .withColumns({"c0": F.greatest("c0", edge), "c1": F.least("c1", edge + (tile - 1))})
    )
    cols = [*keys, "tile_r", "tile_c", "r", "c0", "c1", "_c0", *keep]

    def kernel(table: pa.Table) -> pa.Table:
        r, c0, c1 = (table[x].to_numpy() for x in ("r", "c0", "c1"))
        if c0.min() < -SHIFT or c1.max() >= SHIFT:
            raise ValueError(f"columns of parts have to lie from {-SHIFT} to {SHIFT - 1}")
        feature = _features(table, [*keys, "tile_r", "tile_c"])
        order = np.lexsort((c0, r, feature))
        table, feature, r, c0, c1 = table.take(order), feature[order], r[order], c0[order], c1[order]
        first = _smallest_linked(len(r), *_touching(feature, r, c0, c1, link))
        number = (r[first] << BITS) + (c0[first] + SHIFT)
        return table.select(cols).append_column("label", pa.array(number))

    pieces = pieces.select(cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return _by_square(pieces, ["tile_r", "tile_c"], tile).applyInArrow(kernel, schema + ", label long")


def _by_square(rows: DataFrame, places: list[str], side: int) -> GroupedData:
    """Rows grouped by their place in squares of ``side`` cells, of which so many make a group that it spans ``TILE`` cells.

    The partition count is given, as for the tiles of neighbourhoods: adaptive
    coalescing goes by bytes, and would leave much labelling to one task.
    """
    many = max(1, TILE // side)
    square = {f"_g{i}": div(F.col(x), many) for i, x in enumerate(places)}
    rows = rows.withColumns(square).repartition(shuffle_partitions(rows.sparkSession), *square)
    return rows.groupBy(*square)


def _nodes(feature: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct pairs of feature and label, in that order, and one place of each."""
    order = np.lexsort((label, feature))
    first = np.append(True, (np.diff(feature[order]) != 0) | (np.diff(label[order]) != 0))
    number = np.empty(len(label), np.int64)
    number[order] = np.cumsum(first) - 1
    return number, order[first]


def merge_borders(pieces: DataFrame, keys: list[str], link: Sequence[int], tile: int) -> DataFrame | None:
    """``label, root`` for every label that is not the smallest of its part; none if no two touch.

    Tiles are united by ``FAN`` in each direction, level by level. A level knows
    the runs on the outer borders of what it unites, joins the labels that touch
    there, hands on the runs on its own outer border, and notes which label became
    which. So the number of rounds is that of the levels, whatever the shape
    of the parts, and a task holds a border and not an area. At last the notes are
    followed from the highest level down. Up to ``ALONE`` runs need one level.
    """
    ends = pieces.agg(*[f(x) for x in ("tile_r", "tile_c") for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return None
    r0, c0 = ends[0] * tile, ends[2] * tile
    span, side, notes = max(ends[1] - ends[0], ends[3] - ends[2]) + 1, tile, []
    runs = pieces.select(*keys, "r", "c0", "c1", "label").filter(_on_border(r0, c0, side, link))
    spark, fields = pieces.sparkSession, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
    few = side < tile * span and runs.limit(ALONE + 1).count() <= ALONE
    while side < tile * span:
        side = tile * span if few else side * FAN
        square = {"sr": div(F.col("r") - r0, side), "sc": div(F.col("c0") - c0, side)}
        grouped = _by_square(runs.withColumns(square), list(square), side)
        united = grouped.applyInArrow(_unite(keys, link), fields + ", old long")
        united, path = write_step(united.filter(F.col("old").isNotNull() | _on_border(r0, c0, side, link)))
        note = united.filter(F.col("old").isNotNull()).select(*keys, "old", "label")
        notes.append((note, note.count(), path))
        runs = united.filter(F.col("old").isNull()).drop("old")
    roots, held = None, []
    for note, count, path in reversed(notes):
        if not count:
            remove_step(spark, path)
            continue
        if roots is not None:
            note = lookup(note, roots, [*keys, "label"], count)
            note = note.select(*keys, "old", F.coalesce("root", "label").alias("label"))
        note = note.select(*keys, F.col("old").alias("label"), F.col("label").alias("root"))
        if roots is None:  # often the only one, and stored already
            roots, held = note, [path]
            continue
        roots, after = write_step(roots.unionByName(note))
        for before in (*held, path):
            remove_step(spark, before)
        held = [after]
    return roots


def _on_border(r0: int, c0: int, side: int, link: Sequence[int]):
    """Whether a run, which lies in one square, may be linked to one outside its square."""
    r, rows, most = F.pmod(F.col("r") - r0, F.lit(side)), len(link) - 1, max(link)
    left, right = F.pmod(F.col("c0") - c0, F.lit(side)), F.pmod(F.col("c1") - c0, F.lit(side))
    return (r < rows) | (r >= side - rows) | (left < most) | (right >= side - most)


def _unite(keys: list[str], link: Sequence[int]):
    """The kernel of a level: runs with new labels, and the labels that changed."""

    def kernel(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        r, c0, c1, label = (table[x].to_numpy() for x in ("r", "c0", "c1", "label"))
        feature = _features(table, [*keys, "sr", "sc"])
        table = table.select([*keys, "r", "c0", "c1", "label"])
        order = np.lexsort((c0, r, feature))
        table, feature, r, c0, c1, label = table.take(order), feature[order], r[order], c0[order], c1[order], label[order]
        a, b = _touching(feature, r, c0, c1, link)
        node, at = _nodes(feature, label)
        root = _smallest_linked(len(at), node[a], node[b])
        names = label[at]
        place = table.schema.get_field_index("label")
        kept = table.set_column(place, "label", pa.array(names[root[node]]))
        kept = kept.append_column("old", pa.nulls(len(r), pa.int64()))
        gone = np.flatnonzero(root != np.arange(len(at)))
        noted = table.take(at[gone]).set_column(place, "label", pa.array(names[root[gone]]))
        return pa.concat_tables([kept, noted.append_column("old", pa.array(names[gone]))])

    return kernel


def _features(table: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each distinct combination of keys; nulls are a value of their own."""
    number = np.zeros(table.num_rows, np.int64)
    for key in keys:
        coded = table[key].combine_chunks().dictionary_encode()
        place = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
        number = np.unique(number * (len(coded.dictionary) + 1) + place, return_inverse=True)[1]
    return number


def _star(edges: DataFrame, keys: list[str], rows: int, large: bool) -> DataFrame:
    """One star step on edges ``u > v``: link neighbours to their smallest one."""
    if large:
        back = edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))
        edges, rows = edges.unionByName(back), 2 * rows
    smallest = edges.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    linked = lookup(edges, smallest, [*keys, "u"], rows, "inner")
    low = F.least("u", "m")
    if large:
        out = linked.filter("v > u").select(*keys, F.col("v").alias("u"), low.alias("v"))
    else:
        out = linked.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select(*keys, "u", F.col("m").alias("v"))
        )
    return out.filter("u > v").distinct()


def _contract(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Fewer edges with the same components: each batch of them becomes stars."""
    node = [*keys, "u"]

    def stars(batches):
        for batch in batches:
            table = batch.to_pandas()
            ends = pd.concat([table[node], table[[*keys, "v"]].set_axis(node, axis=1)])
            ids = ends.groupby(node, sort=True, dropna=False).ngroup().to_numpy()
            names = np.empty(ids.max(initial=-1) + 1, dtype=np.int64)
            names[ids] = ends["u"]
            root = _smallest_linked(len(names), ids[: len(table)], ids[len(table) :])
            out = ends.assign(v=names[root[ids]]).drop_duplicates()
            yield pa.RecordBatch.from_pandas(out[out["u"] != out["v"]], preserve_index=False)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.select(*node).schema)
    return edges.select(*node, "v").mapInArrow(stars, fields + ", v long")


def star_components(edges: DataFrame, keys: list[str]) -> DataFrame | None:
    """``u, root`` for every node that is not the smallest of its component; none without edges.

    Star rounds run until they change nothing; each removes the table of the
    round before.
    """
    spark = edges.sparkSession
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
    edges, path = write_step(_contract(edges, keys).distinct())
    state = edges.agg(*mark).first()
    if not state["n"]:
        return None
    while True:
        edges, after = write_step(_star(_star(edges, keys, state["n"], True), keys, state["n"], False))
        remove_step(spark, path)
        before, state, path = state, edges.agg(*mark).first(), after
        if state == before:
            return edges.withColumnRenamed("v", "root")


def label_parts(runs: DataFrame, keys: list[str], diagonal: bool = True, tile: int = TILE) -> DataFrame:
    """Runs with their connected part, named by its first cell ``part_r, part_c``.

    Parts are 8-connected with ``diagonal``, else 4-connected, and never join
    runs of different keys.
    """
    return link_parts(runs, keys, EIGHT if diagonal else FOUR, tile)


def link_parts(
    runs: DataFrame, keys: list[str], link: Sequence[int], tile: int = TILE, keep: Sequence[str] = ()
) -> DataFrame:
    """As ``label_parts``, for cells that are linked over some distance.

    Cells ``d`` rows apart are linked if their columns differ by ``link[d]`` at
    most, and not at all if there is no such entry. Runs are maximal, and come
    back as they were, with their columns ``keep``.
    """
    pieces = cut_lineage(_label_tiles(runs, keys, link, tile, keep))
    roots = merge_borders(pieces, keys, link, tile)
    if roots is None:
        named = pieces.withColumnRenamed("label", "_n")
    else:
        named = lookup(pieces, roots, [*keys, "label"], pieces.count())
        named = named.withColumn("_n", F.coalesce("root", "label"))
    whole = named.groupBy(*keys, "r", "_c0").agg(
        F.min("_n").alias("_n"), F.max("c1").alias("c1"), *[F.first(x).alias(x) for x in keep]
    )
    return whole.select(
        *keys, cell_row(F.col("_n")).alias("part_r"), cell_col(F.col("_n")).alias("part_c"),
        "r", F.col("_c0").alias("c0"), "c1", *keep,
    )
