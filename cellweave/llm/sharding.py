"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

A group (rows of equal text) has a size in each of three dimensions. Groups go,
largest first, to the shard where the dot product of their size with the
shard's residual capacity is highest. To place any number of groups with a
bounded list, only groups over ``1 / LARGE`` of a shard are placed one by one;
all others are united by hash to at most ``CLASSES * BUNDLES`` bundles, which
are placed as one each. Bundles are made by class of row size, so some are heavy
in rows and some in bytes, and the packing can trade them. A group that no shard
can hold is cut into pieces by row.

So the list of what is placed has a fixed bound, whatever the input, and is
packed in numpy; rows find their shard by a broadcast of it. Slots number the
rows of a shard without gaps: rows are counted by shard and a hash of the row,
and numbered inside those parts, so no task holds a shard.

Defined results: null text counts as empty. Repeated rows are rows of their
own; null ids are allowed. Ties go to the shard with the lowest number. An empty
table gives an empty result. Columns of the input named like those added are
replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.registry import query
from cellweave.llm.text import WORD, table
from cellweave.session import cut_lineage

SHARDS = 24
OVERHEAD = 8
#: Groups over this part of a shard's capacity are placed one by one.
LARGE = 64
#: Pieces of a group that is too large are this part of a shard's capacity at most.
PIECE = 8
CLASSES = 4
BUNDLES = 1024
#: Rows that are numbered together.
NUMBERED = 5_000
#: The law of this sharding is near equal bytes, so they weigh most in the dot product.
WEIGHTS = (8.0, 1.0, 1.0)
DIMENSIONS = ("size", "tokens", "rows")


def pack(items: np.ndarray, shards: int, weights=WEIGHTS) -> np.ndarray:
    """The shard of each item, a row of sizes."""
    capacity = items.sum(axis=0) / shards
    unit = np.divide(items, capacity, out=np.zeros(items.shape), where=capacity > 0)
    residual = np.ones((shards, items.shape[1]))
    placed = np.zeros(len(items), np.int64)
    scaled = unit * np.asarray(weights)
    for i in np.lexsort((np.arange(len(items)), -scaled.sum(axis=1))):
        placed[i] = best = int(np.argmax(residual @ scaled[i]))
        residual[best] -= unit[i]
    return placed


def _raw(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _row_hash(ids: list[str]) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids], F.col("_group"))


def _sized(docs: DataFrame, text: str, tokens: bool) -> DataFrame:
    raw = _raw(text)
    out = docs.withColumns({"size": F.octet_length(raw).cast("long") + OVERHEAD, "_group": F.xxhash64(raw)})
    return out.withColumn("_tokens", F.regexp_count(raw, F.lit(WORD)).cast("long")) if tokens else out


def _bundle(mean: float) -> Column:
    """Number of the bundle of a row, by its size and group."""
    kind = sum((F.col("size") > mean * f).cast("int") for f in (0.5, 1.0, 2.0))
    return kind * BUNDLES + F.pmod("_group", F.lit(BUNDLES)).cast("int")


def assign_shards(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size`` and ``shard``; rows of equal text share a shard, unless none can hold them."""
    spark = docs.sparkSession
    docs = docs.drop("size", "shard")
    groups = cut_lineage(
        _sized(docs.select(doc_id, text), text, True)
        .groupBy("_group")
        .agg(
            F.max("size").alias("size"),
            F.sum("size").alias("bytes"),
            F.sum("_tokens").alias("tokens"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    total = groups.agg(F.sum("bytes"), F.sum("rows")).first()
    if not total[1]:
        return _sized(docs, text, False).withColumn("shard", F.lit(0)).drop("_group")
    capacity, mean = total[0] / shards, total[0] / total[1]
    large = F.col("bytes") > capacity / LARGE  # fewer than LARGE * shards groups
    heavy = groups.filter(large).orderBy("_group").collect()
    bundles = (
        groups.filter(~large)
        .groupBy(_bundle(mean).alias("item"))
        .agg(F.sum("bytes"), F.sum("tokens"), F.sum("rows"))
        .orderBy("item")
        .collect()
    )  # CLASSES * BUNDLES at most
    first = CLASSES * BUNDLES
    cuts = {r["_group"]: -(-r["bytes"] * PIECE // int(capacity)) for r in heavy if r["bytes"] > capacity}
    starts, at = {}, first
    for r in heavy:
        starts[r["_group"]] = at
        at += cuts.get(r["_group"], 1)
    placing = spark.createDataFrame(
        [(g, s, int(cuts.get(g, 1))) for g, s in starts.items()], "_group long, _first int, _cuts int"
    )
    item = F.coalesce(
        F.col("_first") + F.pmod(_row_hash([doc_id]), F.col("_cuts").cast("long")).cast("int"), _bundle(mean)
    )
    rows = _sized(docs, text, False).join(F.broadcast(placing), "_group", "left").withColumn("_item", item)
    items = {r["item"]: r[1:] for r in bundles}
    items |= {starts[r["_group"]]: (r["bytes"], r["tokens"], r["rows"]) for r in heavy if r["_group"] not in cuts}
    if cuts:
        size_of = {r["_group"]: (r["bytes"] / r["rows"], r["tokens"] / r["rows"]) for r in heavy}
        pieces = rows.filter("_cuts > 1").groupBy("_group", "_item").count().collect()  # PIECE + 1 for each shard at most
        items |= {r["_item"]: (*(x * r["count"] for x in size_of[r["_group"]]), r["count"]) for r in pieces}
    names = sorted(items)
    found = pack(np.array([items[i] for i in names], float), shards)
    shard_of = spark.createDataFrame([(i, int(s)) for i, s in zip(names, found)], "_item int, shard int")
    return rows.join(F.broadcast(shard_of), "_item").drop("_item", "_group", "_first", "_cuts")


def number_slots(placed: DataFrame, rows: int, ids: list[str], shards: int = SHARDS) -> DataFrame:
    """``placed`` with ``slot``, the place of a row in its shard, without gaps from 0.

    Rows are in order of a hash of ``ids``; ``rows`` is their count.
    """
    placed = placed.drop("slot")
    parts = max(1, -(-rows // (shards * NUMBERED)))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids]
    rows = placed.withColumn("_hash", F.xxhash64(*named)).withColumn("_part", F.pmod("_hash", F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_part").count().select(
        "shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("shard", "_part").orderBy("_hash", *ids)
    return (
        rows.withColumn("_place", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "_part"])
        .withColumn("slot", F.col("_before") + F.col("_place"))
        .drop("_hash", "_part", "_place", "_before")
    )


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``."""
    placed = assign_shards(docs, shards, doc_id, text).withColumn("_crc", F.crc32(_raw(text).cast("binary")))
    added = ["size", "shard", "slot"]
    numbered = number_slots(placed, docs.count(), [doc_id, "_crc"], shards)
    return numbered.select(*[c for c in docs.columns if c not in added], *added)


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    placed = cut_lineage(
        placed.select("doc_id", "size", F.crc32(_raw("text").cast("binary")).alias("text_crc32"), "shard")
    )
    slots = number_slots(placed, placed.count(), ["doc_id", "text_crc32"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
