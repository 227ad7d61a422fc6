"""Exact top-k search by inner product: distributed histogram selection.

Queries are taken in blocks of bounded size. For a block every vector is scored,
and what a task hands on is a histogram of its scores for each query, cut below
the bucket that holds the task's own kth score, since the global kth score cannot
lie lower. The sum of the histograms tells which bucket holds the global kth
score; that bucket is divided again, until it is one score wide or what is above
its lower edge is exactly k. A last pass keeps rows at or above that edge, at
most k of them a query and task (the order is total, so no other can win), and
ranks them. No score but those of winners is ever stored or shuffled, and ties
of any number cost no more.

Scores are whole numbers: matrix products of doubles where all partial sums stay
below 2^53, of Python's whole numbers otherwise.

Defined results: vectors that are null or hold null or non-finite entries take no
part; shorter vectors count as filled up with zeros. A query is a row, its
candidates are all other rows, so a repeated row is found by its copy, and two
equal queries give each their result. A row without an id is no query but may be
found; it loses ties. Ties go to the smaller id. Queries with fewer than k other
rows get all of them; an empty table gives an empty result. Other columns are left
out. Scores outside 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.registry import query
from cellweave.llm.text import table
from cellweave.session import remove_step, shared_path, write_step

SCALE = 256
K = 5
#: Queries scored together: their vectors are broadcast, so a block is bounded in rows and in bytes.
BLOCK_ROWS, BLOCK_BYTES = 2048, 32 << 20
#: Rows scored against a block at once.
ROWS = 1024
BUCKETS = 256
EXACT = 1 << 53


def usable(df: DataFrame, vector: str) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(vector).isNotNull()).filter(~bad)


def on_grid(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """``floor(scale * entry)``, a row for each vector, filled up with zeros; doubles that hold whole numbers."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    """Doubles that hold whole numbers, as Python's."""
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: rows by queries."""
    most = [np.abs(x).max(initial=0.0) for x in (queries, rows)]
    if most[0] * most[1] * queries.shape[1] < EXACT:
        return (rows @ queries.T).astype(np.int64)
    exact = _whole(rows) @ _whole(queries).T
    if exact.size and max(abs(exact.min()), abs(exact.max())) >= 1 << 62:
        raise ValueError("a score does not fit 64 bits")
    return exact.astype(np.int64)


def _scored(batches: Iterator[pa.RecordBatch], asked: np.ndarray, scale: int):
    """Ids and scores of some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0), scores(asked, on_grid(part.column(1), scale, asked.shape[1]))


def histograms(
    rows: DataFrame, asked, low: np.ndarray, width: np.ndarray, open_: np.ndarray, k: int, scale: int
) -> DataFrame:
    """``q, bucket, n``: the upper end of the histogram of scores of each open query, from its ``low`` on.

    Scores beyond the last bucket count in the one after it. A query's own
    score is in the counts; the caller takes it off.
    """

    def run(batches):
        queries = np.flatnonzero(open_)
        if not len(queries):
            return
        block, edge, step = asked.value[queries], low[queries], width[queries]
        counts = np.zeros((len(queries), BUCKETS + 1), np.int64)
        for _, found in _scored(batches, block, scale):
            row, col = np.nonzero(found >= edge)
            bucket = np.minimum((found[row, col] - edge[col]) // step[col], BUCKETS)
            counts += np.bincount(col * (BUCKETS + 1) + bucket, minlength=counts.size).reshape(counts.shape)
        # From the top down; one more than k, as the query itself may be among them.
        before = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, bucket = np.nonzero((counts > 0) & (before < k + 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(queries[q].astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[q, bucket])],
            names=["q", "bucket", "n"],
        )

    return rows.mapInArrow(run, "q int, bucket int, n long").groupBy("q", "bucket").agg(F.sum("n").alias("n"))


def kth_edges(rows: DataFrame, asked, norms: np.ndarray, longest: float, own: np.ndarray, k: int, scale: int) -> np.ndarray:
    """For each query of a block a score that its kth best candidate reaches, and no more rows than need be."""
    reach = np.floor(norms * longest).astype(np.int64) + 2  # no inner product is larger than the product of lengths
    low, width = -reach, (2 * reach + 1 + BUCKETS - 1) // BUCKETS
    open_ = np.ones(len(norms), bool)
    while open_.any():
        parts = histograms(rows, asked, low, width, open_, k, scale).toPandas()
        parts = parts.sort_values(["q", "bucket"], ascending=[True, False])
        by_query = {q: (g["bucket"].to_numpy(), g["n"].to_numpy()) for q, g in parts.groupby("q")}
        for q in np.flatnonzero(open_):
            bucket, n = by_query[q]  # never empty: the query finds itself
            mine = min(max((own[q] - low[q]) // width[q], 0), BUCKETS) if own[q] >= low[q] else -1
            n = n - (bucket == mine)
            total = np.cumsum(n)
            enough = np.flatnonzero(total >= k)
            if not len(enough):  # fewer candidates than k: all of them
                open_[q] = False
                continue
            at = enough[0]
            low[q] += int(bucket[at]) * width[q]
            if total[at] == k or width[q] == 1:
                open_[q] = False
            width[q] = -(-width[q] // BUCKETS)
    return low


def _winners(rows: DataFrame, asked, low: np.ndarray, k: int, scale: int) -> DataFrame:
    """``q, key, score`` of rows that reach the edge of a query, the first k + 1 of each task."""

    def run(batches):
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        for keys, found in _scored(batches, asked.value, scale):
            row, q = np.nonzero(found >= low)
            if len(row):
                named, ids = keys.is_valid().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy(zero_copy_only=False)
                best = first(*map(np.concatenate, zip(best, (q, -found[row, q], ~named[row], ids[row]))))
        q, score, unnamed, ids = best
        yield pa.RecordBatch.from_arrays(
            [pa.array(q.astype(np.int32)), pa.array(ids, mask=unnamed), pa.array(-score)], names=["q", "key", "score"]
        )

    def first(q, score, unnamed, ids):
        """The best of each query: by score, then id, those without one last."""
        order = np.lexsort((ids, unnamed, score, q))
        start = np.searchsorted(q[order], q[order])
        order = order[np.arange(len(order)) - start <= k]
        return q[order], score[order], unnamed[order], ids[order]

    return rows.mapInArrow(run, "q int, key long, score long")


def search(
    df: DataFrame, key: str, vector: str, is_query: Column, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``k`` best other rows of each row for which ``is_query`` holds: ``query_id, rank, key, score``.

    ``key`` is a whole number. Each block of queries is answered before the next
    and stored, so memory does not grow with the number of queries.
    """
    spark = df.sparkSession
    rows = usable(df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), is_query.alias("asked")), "vector")
    facts = rows.agg(F.max(F.size("vector")), F.count(F.when(F.col("asked") & F.col("key").isNotNull(), 1))).first()
    dims, count = max(facts[0] or 0, 1), facts[1]
    schema = "query_id long, rank int, key long, score long"
    path = shared_path(spark, "topk")
    spark.createDataFrame([], schema).write.parquet(path)
    per_block = max(1, min(block_rows, BLOCK_BYTES // (8 * dims)))
    blocks = -(-count // per_block)
    # Whatever the ids, blocks are even: queries are numbered, and the numbers hashed, once.
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(blocks, 1)))
    queries, held = write_step(
        rows.filter(F.col("asked") & F.col("key").isNotNull()).select("key", "vector", number.alias("block"))
    )
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") * scale, F.lit(2.0)))
    # Rounding down moves a vector by the square root of its length at most.
    longest = (float(np.sqrt(rows.agg(F.max(squares)).first()[0] or 0.0)) + np.sqrt(dims)) * (1 + 1e-9)
    candidates = rows.select("key", "vector")
    for block in range(blocks):
        found = queries.filter(F.col("block") == block).select("key", "vector").toArrow().combine_chunks()
        if not found.num_rows:
            continue
        ids = found["key"].combine_chunks().to_numpy()
        vectors = on_grid(found["vector"].combine_chunks(), scale, dims)
        own = np.concatenate([scores(v[None], v[None])[0] for v in vectors])
        norms = np.sqrt(own.astype(float)) * (1 + 1e-9)
        asked = spark.sparkContext.broadcast(vectors)
        edges = kth_edges(candidates, asked, norms, longest, own, k, scale)
        names = spark.createDataFrame(
            pa.table({"q": pa.array(range(len(ids)), pa.int32()), "query_id": ids, "own": own})
        )  # a block at most
        best = _winners(candidates, asked, edges, k, scale).join(F.broadcast(names), "q")
        # Of rows that look like the query itself one is the query.
        itself = (F.col("key").eqNullSafe(F.col("query_id"))) & (F.col("score") == F.col("own"))
        alike = F.row_number().over(Window.partitionBy("q", "key", "score").orderBy("query_id"))
        best = best.withColumn("alike", alike).filter(~(itself & (F.col("alike") == 1)))
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "key", "score").write.mode("append").parquet(path)
        asked.destroy()
    remove_step(spark, held)
    return spark.read.schema(schema).parquet(path)


OP12_SQL = """WITH e AS (SELECT row_number() OVER () AS id, vec_id, x FROM (
SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE embedding IS NOT NULL
AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)),
cell AS (SELECT id, vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e),
scored AS (SELECT q.id AS qid, q.vec_id AS query_id, c.id, c.vec_id, CAST(sum(q.v * c.v) AS BIGINT) AS score
FROM cell q JOIN cell c ON q.i = c.i AND q.id <> c.id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER
(PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""


@query("op12_topk_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = search(vectors, "vec_id", "embedding", F.pmod("vec_id", F.lit(50)) == 0)
    return found.withColumnRenamed("key", "vec_id")
