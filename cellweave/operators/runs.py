"""Cell sets as runs: intervals along grid rows, merged and swept with windows.

Keys name the feature a run belongs to; without keys all runs form one set. A
window holds the runs of one feature in one block of a grid row, and what touches
the block's ends is joined after that, so neither a feature nor a row of the grid
has to fit a task.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.session import div


#: Columns of a grid row that are merged together.
BLOCK = 8192


def _union(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Union of intervals that agree in ``by``: overlapping or touching ones become one run."""
    row = W.partitionBy(*by).orderBy("c0", "c1")
    so_far = row.rowsBetween(W.unboundedPreceding, -1)
    up_to = row.rowsBetween(W.unboundedPreceding, W.currentRow)
    opens = F.coalesce((F.col("c0") > F.max("c1").over(so_far) + 1).cast("int"), F.lit(1))
    return (
        pieces.withColumn("_open", opens)
        .withColumn("_run", F.sum("_open").over(up_to))
        .groupBy(*by, "_run")
        .agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"))
        .drop("_run")
    )


def in_blocks(runs: DataFrame, block: int) -> DataFrame:
    """Runs cut at the borders of blocks of columns, with the number of their block."""
    first = F.col("block") * block
    return runs.withColumn(
        "block", F.explode(F.sequence(div(F.col("c0"), block), div(F.col("c1"), block)))
    ).withColumns({"c0": F.greatest("c0", first), "c1": F.least("c1", first + (block - 1))})


def _join_ends(pieces: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Runs that were cut into blocks: those that touch across the ends of blocks become one."""
    first = F.col("block") * block
    at_end = (F.col("c0") == first) | (F.col("c1") == first + (block - 1))
    # A run inside its block meets no other; all at an end share a group of their row.
    apart = pieces.withColumn("block", F.when(~at_end, F.col("block")))
    return _union(apart, [*keys, "r", "block"]).drop("block")


def merge_runs(pieces: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Union of intervals ``r, c0, c1``: overlapping or touching ones become one run."""
    cut = in_blocks(pieces.select(*keys, "r", "c0", "c1"), block)
    return _join_ends(_union(cut, [*keys, "r", "block"]), keys, block)


def _batch_runs(batches):
    """Runs within each batch of ``keys, r, c`` rows, repeated cells once."""
    for batch in batches:
        df = batch.to_pandas()
        row = list(df.columns[:-1])
        df = df.sort_values([*row, "c"], ignore_index=True).drop_duplicates(ignore_index=True)
        first = (df[row] != df[row].shift()).any(axis=1) | (df["c"].diff() != 1)
        last = first.shift(-1, fill_value=True)
        out = df[first].rename(columns={"c": "c0"})
        out["c1"] = df["c"][last].to_numpy()
        yield pa.RecordBatch.from_pandas(out, preserve_index=False)


def to_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of a cell set; null and repeated cells count once or not at all.

    Cells are joined to runs batch by batch before the shuffle, so it moves
    pieces of runs rather than cells.
    """
    present = cells.select(*keys, "r", "c").dropna(subset=["r", "c"])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in present.drop("c").schema)
    return merge_runs(present.mapInArrow(_batch_runs, fields + ", c0 long, c1 long"), keys)


def dissolve_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the runs of several features; ``keys`` name what stays apart."""
    return merge_runs(runs, keys)


def to_cells(runs: DataFrame) -> DataFrame:
    return runs.withColumn("c", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def disk(distance: float, size: float) -> list[tuple[int, int]]:
    """Row offsets and half-widths of the cells within a distance of a cell."""
    k = math.floor(distance / size)
    cap = (distance / size) ** 2
    return [(d, math.isqrt(math.floor(cap - d * d))) for d in range(-k, k + 1)]


def _spread(runs: DataFrame, shape: list[tuple[int, int]]) -> DataFrame:
    offsets = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in shape])
    return runs.withColumn("_o", F.explode(offsets))


def dilate(runs: DataFrame, distance: float, size: float, keys: list[str]) -> DataFrame:
    """All cells within a distance. Dropping keys first merges features.

    Work grows with runs times rows of the disk, not with cells times its area.
    """
    grown = _spread(runs, disk(distance, size)).select(
        *keys,
        (F.col("r") + F.col("_o.d")).alias("r"),
        (F.col("c0") - F.col("_o.w")).alias("c0"),
        (F.col("c1") + F.col("_o.w")).alias("c1"),
    )
    return merge_runs(grown, keys)


def erode(runs: DataFrame, distance: float, size: float, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Cells whose whole disk lies in the feature; outside the extent is absent.

    Each disk row contributes the columns it allows; a sweep along a block of
    the grid row keeps those that every disk row allows.
    """
    shape = disk(distance, size)
    allowed = (
        _spread(runs, shape)
        .select(
            *keys,
            (F.col("r") - F.col("_o.d")).alias("r"),
            (F.col("c0") + F.col("_o.w")).alias("c0"),
            (F.col("c1") - F.col("_o.w")).alias("c1"),
        )
        .filter("c0 <= c1")
    )
    step = F.explode(
        F.array(
            F.struct(F.col("c0").alias("at"), F.lit(1).alias("by")),
            F.struct((F.col("c1") + 1).alias("at"), F.lit(-1).alias("by")),
        )
    )
    part = [*keys, "r", "block"]
    row = W.partitionBy(*part).orderBy("at")
    kept = (
        in_blocks(allowed, block)
        .select(*part, step.alias("s"))
        .groupBy(*part, F.col("s.at").alias("at"))
        .agg(F.sum("s.by").alias("by"))
        .filter("by <> 0")
        .select(
            *part,
            F.col("at").alias("c0"),
            (F.lead("at").over(row) - 1).alias("c1"),
            F.sum("by").over(row.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("n"),
        )
        .filter(F.col("n") == len(shape))
        .drop("n")
    )
    return _join_ends(kept, keys, block)


def intersect(runs: DataFrame, other: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """The parts of ``runs`` inside another set of runs, which has no keys."""
    pieces = in_blocks(other.select("r", "c0", "c1"), block).withColumnsRenamed({"c0": "o0", "c1": "o1"})
    met = in_blocks(runs.select(*keys, "r", "c0", "c1"), block).join(pieces, ["r", "block"])
    met = met.filter((F.col("c0") <= F.col("o1")) & (F.col("c1") >= F.col("o0")))
    inside = met.withColumns({"c0": F.greatest("c0", "o0"), "c1": F.least("c1", "o1")}).drop("o0", "o1")
    return _join_ends(_union(inside, [*keys, "r", "block"]), keys, block)


def subtract(runs: DataFrame, other: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """The parts of ``runs`` outside another set of merged runs, which has no keys.

    In each block of a row that the other set reaches, its gaps are what
    remains; where it does not reach, all does.
    """
    first = F.col("block") * block
    row = W.partitionBy("r", "block").orderBy("c0")
    pieces = in_blocks(other.select("r", "c0", "c1"), block).withColumns(
        {"after": F.coalesce(F.lead("c0").over(row), first + block) - 1, "place": F.row_number().over(row)}
    )
    behind = F.struct((F.col("c1") + 1).alias("o0"), F.col("after").alias("o1"))
    before = F.struct(first.alias("o0"), (F.col("c0") - 1).alias("o1"))
    gaps = F.when(F.col("place") == 1, F.array(before, behind)).otherwise(F.array(behind))
    gaps = pieces.select("r", "block", F.explode(gaps).alias("g")).select("r", "block", "g.*")
    met = in_blocks(runs.select(*keys, "r", "c0", "c1"), block).join(gaps, ["r", "block"], "left")
    met = met.filter(
        F.col("o0").isNull() | (F.greatest("c0", "o0") <= F.least("c1", "o1"))
    )  # gaps may be empty; they only tell that the other set reaches the block
    outside = met.withColumns({"c0": F.greatest("c0", "o0"), "c1": F.least("c1", "o1")}).drop("o0", "o1")
    return _join_ends(_union(outside, [*keys, "r", "block"]), keys, block)
