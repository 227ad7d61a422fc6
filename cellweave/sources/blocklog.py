"""The block log of a store: which cells of which block each write has put there.

A block is a square of ``BLOCK`` by ``BLOCK`` cells. An entry holds a compressed
bitmap of the cells that a write stored of a block, with their count and extent,
and range, sum and sum of squares of their values. From it follow the names,
years, extents and statistics of layers, and what a late lot still lacks, without
a look at a stored cell.

The log lies in a folder beside the store, with a partition for every block of a
layer, so a lot reads the entries of the blocks it touches and no others. It is
written after the cells; a write that stopped between the two has to be run
again, as a stream does by itself. A store without a log gets one when it is
first needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.model import CELLS
from cellweave.operators.quadtree import inside
from cellweave.session import shuffle_partitions

BLOCK = 1024
SUFFIX = ".blocks"
#: The batch of cells that were written without one.
NO_BATCH = "-"
#: Blocks that are named one by one when the log is read; beyond, all of the layers touched are read.
NAMED = 5_000
KEY = ["layer", "br", "bc"]
PARTS = ["layer", "year", "batch", "br", "bc"]
STATS = "n long, r0 long, r1 long, c0 long, c1 long, v0 int, v1 int, known long, s1 long, s2 decimal(38,0)"
ENTRY = f"layer string, year int, batch string, br long, bc long, {STATS}, cells binary"
PACKED = "layer string, year int, br long, bc long, at binary, vals array<int>"

def log_path(store: str) -> str:
    return store.rstrip("/") + SUFFIX


def to_bitmap(at: np.ndarray) -> bytes:
    """A compressed bitmap of places within a block; its last bytes that are 0 are left out."""
    flags = np.zeros((int(at.max()) // 8 + 1) * 8 if len(at) else 0, np.uint8)
    flags[at] = 1
    raw = np.packbits(flags).tobytes()
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def from_bitmap(data: bytes, block: int = BLOCK) -> np.ndarray:
    """A flag for each place of a block."""
    raw = pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)
    out = np.zeros(block * block, bool)
    flags = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
    out[: len(flags)] = flags[: len(out)]
    return out


def _by_block(batch: pa.RecordBatch, names: list[str], block: int):
    """Rows of a batch in order of ``names``, block and place; where each group begins; blocks and places."""
    r, c = batch.column("r").to_numpy(), batch.column("c").to_numpy()
    codes = [batch.column(x).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for x in names]
    br, bc = r // block, c // block
    at = ((r - br * block) * block + (c - bc * block)).astype(np.int32)
    keys = np.stack([*codes, br, bc])
    order = np.lexsort((at, *keys[::-1]))
    ends = np.flatnonzero((np.diff(keys[:, order], axis=1, prepend=-2, append=-2) != 0).any(axis=0))
    first = order[ends[:-1]]
    named = [batch.column(x).take(pa.array(first)) for x in names]
    return order, ends, [*named, pa.array(br[first]), pa.array(bc[first])], at[order]


def _typed(cells: DataFrame, *names: str) -> DataFrame:
    return cells.select(
        *names, F.col("year").cast("int"), F.col("r").cast("long"), F.col("c").cast("long"), F.col("v").cast("int")
    )


def pack_blocks(cells: DataFrame, block: int = BLOCK, within: DataFrame | None = None) -> DataFrame:
    """``layer, year, r, c, v`` as records of a block: places as 32-bit numbers, and values.

    Packed batch by batch, so what is shuffled by block are few records and not
    cells. Repeated cells stay. Cells outside the runs ``within`` are dropped
    in the same pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order, ends, keys, at = _by_block(batch, ["layer", "year"], block)
                places = pa.array([at[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
                values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), batch.column("v").take(pa.array(order)))
                yield pa.RecordBatch.from_arrays([*keys, places, values], names=["layer", "year", "br", "bc", "at", "vals"])

    cells = _typed(cells, "layer")
    return cells.mapInArrow(run, PACKED) if within is None else inside(cells, within, then=(run, PACKED))


def unpack_blocks(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The cells of packed records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a record is a block: few in a batch
                part = batch.slice(i, 1)
                at = np.frombuffer(part.column("at")[0].as_py(), np.int32).astype(np.int64)
                same = pa.array(np.zeros(len(at), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("layer").take(same), part.column("year").take(same),
                        pa.array(part.column("br")[0].as_py() * block + at // block),
                        pa.array(part.column("bc")[0].as_py() * block + at % block),
                        part.column("vals").flatten(),
                    ],
                    names=CELLS.names,
                )

    return packed.mapInArrow(run, CELLS)


def _squares(values: np.ndarray) -> Decimal:
    """The exact sum of squares of 32-bit numbers."""
    squares = values.astype(np.int64) ** 2
    return Decimal((int((squares >> 31).sum()) << 31) + int((squares & ((1 << 31) - 1)).sum()))


def entries(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Log entries of ``layer, batch, year, r, c, v``: one for each layer, year, batch and block.

    Each batch of rows gives bitmaps and statistics, which are united by block:
    no cell is shuffled.
    """
    names = ["layer", "batch", "year", "br", "bc", *[x.split()[0] for x in STATS.split(", ")], "cells"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order, ends, keys, at = _by_block(batch, ["layer", "batch", "year"], block)
            values = batch.column("v").take(pa.array(order))
            stats, bitmaps = [], []
            for a, b, br, bc in zip(ends, ends[1:], keys[-2].to_pylist(), keys[-1].to_pylist()):
                r, c = br * block + at[a:b] // block, bc * block + at[a:b] % block
                known = values.slice(a, b - a).drop_null().to_numpy()
                least, most = (int(known.min()), int(known.max())) if len(known) else (None, None)
                ends = int(r.min()), int(r.max()), int(c.min()), int(c.max()), least, most
                stats.append((int(b - a), *ends, len(known), int(known.sum(dtype=np.int64)), _squares(known)))
                bitmaps.append(to_bitmap(at[a:b]))
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.decimal128(38, 0)]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*stats), kinds)]
            yield pa.RecordBatch.from_arrays([*keys, *columns, pa.array(bitmaps, pa.binary())], names=names)

    def unite(table: pa.Table) -> pa.Table:
        held = np.zeros(block * block, bool)
        for bitmap in table["cells"]:
            held |= from_bitmap(bitmap.as_py(), block)
        row = {x: table[x][0].as_py() for x in names[:5]} | {"cells": to_bitmap(np.flatnonzero(held))}
        for kind, of in ((("r0", "c0", "v0"), pc.min), (("r1", "c1", "v1"), pc.max), (("n", "known", "s1", "s2"), pc.sum)):
            row |= {x: of(table[x]).as_py() for x in kind}
        return pa.table({f.name: pa.array([row[f.name]], f.type) for f in table.schema})

    schema = "layer string, batch string, year int, br long, bc long, " + STATS + ", cells binary"
    parts = _typed(cells, "layer", "batch").mapInArrow(part, schema)
    # Few bytes, each opened to a whole block: adaptive coalescing would leave all to one task.
    parts = parts.repartition(shuffle_partitions(cells.sparkSession), *names[:5])
    return parts.groupBy(*names[:5]).applyInArrow(unite, schema)


def _forget(spark: SparkSession, store: str, layers: list[str], batch: str) -> None:
    """Remove the entries of a batch of some layers, of whatever year."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for layer in layers:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{log_path(store)}/layer={escape(layer)}/year=*/batch={escape(batch)}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.globStatus(path) or []:
            files.delete(found.getPath(), True)


def write_log(spark: SparkSession, store: str, written: DataFrame, layers: list[str], batch: str, block: int = BLOCK) -> None:
    """Log the stored cells ``layer, year, batch, r, c, v`` of a batch of some layers; their earlier entries go."""
    _forget(spark, store, layers, batch)
    # A partition of the log is one entry, so each is a file of its own.
    entries(written, block).write.mode("append").partitionBy(*PARTS).parquet(log_path(store))


def read_log(spark: SparkSession, store: str) -> DataFrame | None:
    """All entries, or None where nothing is logged."""
    try:
        return spark.read.schema(ENTRY).option("basePath", log_path(store)).parquet(log_path(store))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def touched(log: DataFrame, packed: DataFrame, named: int = NAMED) -> DataFrame:
    """Entries of the blocks that packed records touch: the scan reads their partitions only."""
    blocks = packed.select(*KEY).distinct().limit(named + 1).collect()
    if len(blocks) > named:  # more blocks than a plan should name: those of their layers
        layers = [r["layer"] for r in packed.select("layer").distinct().limit(named + 1).collect()]
        return log.filter(F.col("layer").isin(layers)) if len(layers) <= named else log
    place = F.concat_ws("/", F.col("br").cast("string"), F.col("bc").cast("string"), "layer")
    return log.filter(place.isin([f"{b['br']}/{b['bc']}/{b['layer']}" for b in blocks]))


def lacking(packed: DataFrame, log: DataFrame, block: int = BLOCK) -> DataFrame:
    """Packed records of the cells that no entry of the log holds; one record for each layer and block.

    Bitmaps of a block are united and the places of its incoming cells looked up
    in the union, in one call. Of repeated cells with one place all stay.
    """
    names = ["layer", "year", "br", "bc", "at", "vals"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(names)
        held = np.zeros(block * block, bool)
        for bitmap in right["cells"]:
            held |= from_bitmap(bitmap.as_py(), block)
        out = []
        for i in range(left.num_rows):
            at = np.frombuffer(left["at"][i].as_py(), np.int32)
            new = ~held[at]
            if new.any():
                values = pa.array(left["vals"][i].values).filter(pa.array(new))
                out.append((i, at[new].tobytes(), values))
        rows = left.take(pa.array([i for i, _, _ in out], pa.int64()))
        places = pa.array([a for _, a, _ in out], pa.binary())
        ends = np.cumsum([0] + [len(v) for _, _, v in out]).astype(np.int32)
        values = pa.concat_arrays([v for _, _, v in out]) if out else pa.array([], pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(ends), values)
        return pa.Table.from_arrays([*(rows[x] for x in names[:4]), places, lists], names=names)

    right = log.select("layer", "br", "bc", "cells")
    return packed.groupBy(*KEY).cogroup(right.groupBy(*KEY)).applyInArrow(run, PACKED)


def catalogue(log: DataFrame) -> DataFrame:
    """One row for each stored layer, from the log alone.

    ``layer, year, n, r0, r1, c0, c1, v0, v1, mean_v, std_v``: cells, extent, and
    range, mean and standard deviation of the values that are not NoData.
    """
    ends = [F.min(x).alias(x) for x in ("r0", "c0", "v0")] + [F.max(x).alias(x) for x in ("r1", "c1", "v1")]
    sums = [F.sum(x).alias(x) for x in ("n", "known", "s1", "s2")]
    found = log.groupBy("layer", "year").agg(*sums, *ends)
    known = F.nullif("known", F.lit(0))
    mean = F.col("s1") / known
    spread = F.sqrt(F.greatest(F.col("s2").cast("double") / known - mean * mean, F.lit(0.0)))
    return found.select("layer", "year", "n", "r0", "r1", "c0", "c1", "v0", "v1", mean.alias("mean_v"), spread.alias("std_v"))
