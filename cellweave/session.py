"""Session helpers: the shared folder, step tables that cut lineage, skew-safe lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

# At most this many keys can each hold more than 1/HEAVY_KEYS of the rows, so a
# table of them is small enough to broadcast whatever the size of the data.
HEAVY_KEYS = 2000
# Below this many rows a key is never heavy.
HEAVY_FLOOR = 100_000


# What this process wrote and may remove: paths of step tables by application.
_steps: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the session names, else one below its warehouse."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/steps"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_step(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and where it is."""
    spark = df.sparkSession
    path = shared_path(spark, "step")
    df.write.parquet(path)
    _steps.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back; the result survives the loss of executors.

    As a table, unlike a checkpoint, it is counted from its footers, read by
    column, and has a size the optimizer knows.
    """
    return write_step(df)[0]


def remove_step(spark: SparkSession, path: str) -> None:
    """Remove one step table that is no longer read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    known = _steps.get(spark.sparkContext.applicationId, [])
    if path in known:
        known.remove(path)


def clear_steps(spark: SparkSession) -> int:
    """Remove all step tables of this application, once their results are stored; how many there were."""
    paths = list(_steps.get(spark.sparkContext.applicationId, []))
    for path in paths:
        remove_step(spark, path)
    return len(paths)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Mark a table for broadcast if it is counted to have at most ``rows`` rows.

    The table is written first, so counting it does not compute it twice. A
    larger one is marked for a sort-merge join, because the optimizer's own
    estimate knows nothing of exploded rows.
    """
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def lookup(left: DataFrame, right: DataFrame, on: list[str], rows: int, how: str = "left") -> DataFrame:
    """Join ``left`` to a table with unique ``on`` keys, whatever their skew.

    ``rows`` is the row count of ``left``. Keys holding more than
    ``rows / HEAVY_KEYS`` rows, of which there are fewer than ``HEAVY_KEYS``,
    are looked up in a broadcast table and never meet in one task; the others
    join as usual.
    """
    limit = max(rows // HEAVY_KEYS, HEAVY_FLOOR)
    if rows <= limit:  # no key can be heavy
        return left.join(right, on, how)
    heavy = left.groupBy(*on).count().filter(F.col("count") > limit).select(*on)
    is_heavy = left.join(F.broadcast(heavy), on, "left_semi")
    light = left.join(F.broadcast(heavy), on, "left_anti")
    right_heavy = right.join(F.broadcast(heavy), on, "left_semi")
    return light.join(right, on, how).unionByName(is_heavy.join(F.broadcast(right_heavy), on, how))


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions a shuffle starts with under the session's settings."""
    initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(initial or spark.conf.get("spark.sql.shuffle.partitions"))


def div(col, by: int):
    """Integer division rounding towards minus infinity."""
    return F.call_function("div", col - F.pmod(col, F.lit(by)), F.lit(by))
