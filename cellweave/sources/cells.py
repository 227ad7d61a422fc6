"""Stored grids: a parquet table of cells partitioned by layer and year."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.columns import layer_period
from cellweave.model import CELLS
from cellweave.operators.runs import to_runs
from cellweave.session import cut_lineage, div
from cellweave.sources.blocklog import (
    ENTRY,
    NO_BATCH,
    catalogue,
    lacking,
    pack_blocks,
    read_log,
    touched,
    unpack_blocks,
    write_log,
)


def read_cells(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """All layers below ``path``; filters on layer and year prune partitions."""
    return spark.read.schema(CELLS).format(format).options(**options).load(path).select(*CELLS.names)


def write_cells(
    cells: DataFrame,
    path: str,
    batch: str | None = None,
    tile: int = 1024,
    block: int = 2,
    layers: list[str] | None = None,
) -> None:
    """Store layers; rerunning a layer replaces that layer only.

    With ``batch`` a rerun replaces only what the same batch wrote of a layer.

    A file holds a block of ``block`` by ``block`` tiles of one layer, sorted by
    tile, so row-group statistics on ``r`` and ``c`` prune extent filters. A
    large layer spreads over tasks by its blocks, and the number of files is that
    of the blocks, not of tasks times layers.

    What was written is read once more, by its own partitions, for the block log.
    ``layers`` may name the layers, if that is known; else ``cells`` is asked for them.
    """
    spark = cells.sparkSession
    tr, tc = div(F.col("r"), tile), div(F.col("c"), tile)
    br, bc = div(F.col("r"), tile * block), div(F.col("c"), tile * block)
    parts = ["layer", "year"]
    cells = cells.select(*CELLS.names)
    if batch is not None:
        parts, cells = [*parts, "batch"], cells.withColumn("batch", F.lit(batch))
    (
        cells.repartition(*parts, br, bc)
        .sortWithinPartitions(*parts, tr, tc, "r", "c")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )
    if layers is None:
        layers = [r["layer"] for r in cells.select("layer").distinct().collect()]  # names of layers
    _log_layers(spark, path, layers, batch)


def _log_layers(spark: SparkSession, path: str, layers: list[str] | None, batch: str | None) -> None:
    """Log the stored cells of some layers, or of all."""
    written = spark.read.parquet(path)
    tag = F.lit(NO_BATCH)
    if "batch" in written.columns:
        tag = F.coalesce(F.col("batch").cast("string"), tag)
        written = written if batch is None else written.filter(F.col("batch") == batch)
    written = written if layers is None else written.filter(F.col("layer").isin(layers))
    written = written.withColumns({"batch": tag, "layer": F.col("layer").cast("string")})
    write_log(spark, path, written, layers or [], batch or NO_BATCH)


def block_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The block log of a store, made now if it has none; None where there is no store."""
    log = read_log(spark, path)
    if log is None:
        try:
            spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        _log_layers(spark, path, None, None)
        log = read_log(spark, path)
    return log


def stored_layers(spark: SparkSession, path: str, pattern: str = "", include: str | None = None) -> DataFrame:
    """Names, years, counts, extents and value ranges of stored layers, from the block log: no cell is read."""
    log = block_log(spark, path)
    log = spark.createDataFrame([], ENTRY) if log is None else log
    keep = F.col("layer").rlike(pattern)
    return catalogue(log.filter(keep & F.col("layer").rlike(include) if include else keep))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def list_layers(cells: DataFrame, pattern: str, include: str | None = None) -> DataFrame:
    """Distinct layer names matching a pattern and, if given, a second one."""
    keep = F.col("layer").rlike(pattern)
    if include:
        keep = keep & F.col("layer").rlike(include)
    return cells.filter(keep).select("layer").distinct()


def stack_tagged(tables: dict[str, DataFrame], tag: str = "data") -> DataFrame:
    """Stack tables, tag each row with its source and add the period of the name."""
    out = None
    for name, df in tables.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("chg_years", layer_period(tag))


def new_cells(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """Cells that a store does not hold yet by its block log, be their layer new or known.

    Incoming cells meet bitmaps, block by block: a layer may arrive in any number
    of lots and a repeated lot adds nothing. No stored cell is read or shuffled.
    """
    packed = cut_lineage(pack_blocks(incoming))
    return unpack_blocks(lacking(packed, touched(log, packed)))


def add_cells(incoming: DataFrame, path: str, batch: str, template: DataFrame | None = None) -> None:
    """Store the cells, those inside a template if given, that no other batch has stored.

    What comes in is computed once, clipped and packed in one pass, and kept till then.
    """
    spark = incoming.sparkSession
    log = block_log(spark, path)
    packed = cut_lineage(pack_blocks(incoming, within=None if template is None else to_runs(template, [])))
    layers = [r["layer"] for r in packed.select("layer").distinct().collect()]
    fresh = packed
    if log is not None:
        fresh = lacking(packed, touched(log.filter(F.col("batch") != batch), packed))
    write_cells(unpack_blocks(fresh), path, batch, layers=layers)


def write_bucketed(layer: DataFrame, table: str, path: str, buckets: int) -> None:
    """Store one layer as a table bucketed by cell.

    Layers with equal buckets overlay without a shuffle.
    """
    (
        layer.select("r", "c", "v")
        .repartition(buckets, "r", "c")
        .write.mode("overwrite")
        .bucketBy(buckets, "r", "c")
        .sortBy("r", "c")
        .option("path", path)
        .saveAsTable(table)
    )
