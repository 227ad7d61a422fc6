"""Incremental ingest: pick up layers, or the rest of layers, that arrived since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.model import CELLS
from cellweave.sources.cells import add_cells


def _add(incoming: DataFrame, target: str, batch: str, template: DataFrame | None) -> None:
    """Write the cells no other batch has written. Running a batch again replaces its output."""
    add_cells(incoming, target, batch, template)


def ingest_batch(incoming: DataFrame, target: str, batch: str, template: DataFrame | None = None) -> None:
    """Add the cells the target does not hold yet, clipped to a template if given."""
    _add(incoming, target, batch, template)


def ingest_available(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    name: str,
    template: DataFrame | None = None,
) -> None:
    """Process the source files not yet seen, then stop.

    All waiting files form one batch. Its output is marked with ``name``, the
    stream's own, and the batch number: a batch delivered twice replaces what it
    wrote, and cells of earlier batches are left alone.
    """

    def store(batch: DataFrame, number: int) -> None:
        _add(batch, target, f"{name}-{number}", template)

    stream = spark.readStream.schema(CELLS).parquet(source)
    (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
