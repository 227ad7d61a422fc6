"""Whitening of embeddings by a bit-sliced scatter matrix.

Entries become whole numbers on a fixed grid. Each dimension is shifted by its
minimum, and the bit planes of the shifted numbers are packed across rows into
words. The number of rows where two planes both have a bit is a population count
of the AND of their words; counts weighted by the planes' powers of two add up to
the exact sums of products of two dimensions. Every task gives one matrix of such
sums, cut into limbs of 30 bits, so that adding them up in Spark stays exact
whatever the number of rows. The covariance is centred in whole numbers, divided
once, and only then decomposed.

What reaches the driver is a matrix of dimensions by dimensions. Rows are read
for the ranges, for the scatter and for the projection; the projection is stored,
and the covariance of the stored result is what ``identity_error`` reports.

Defined results: vectors that are null or hold null or non-finite entries take no
part, and neither do those whose length is not the commonest one (ties: the
longer). Repeated rows count once each. Ids are carried along, null ones too, and
need not be unique; other columns are left out. Components without variance are
not returned: a table of equal vectors, and an empty one, give an empty result.
Of each component the entry largest in size (the first of these) is positive.
Entries outside 2^50 grid steps are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.registry import query
from cellweave.llm.text import table
from cellweave.session import cut_lineage

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows whose bit planes are packed together: 64 words a plane.
ROWS = 4096
#: Bits of a limb of an exact sum; sums of limbs stay exact over 2^33 tasks.
LIMB = 30
#: Largest absolute grid value.
FAR = 1 << 50
#: A component has variance if its eigenvalue exceeds this part of the largest.
RANK = 1e-12


@dataclass(frozen=True)
class Fit:
    """What whitening needs: counts and sums are exact."""

    n: int
    sums: list[int]
    components: np.ndarray  # a row for each
    eigenvalues: np.ndarray
    trace: float


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is finite throughout and has the commonest length."""
    entries = F.col(vector)
    bad = F.exists(entries, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = df.filter(entries.isNotNull()).filter(~bad)
    lengths = whole.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), F.desc("length"))
    common = lengths.first()
    return whole.filter(F.size(vector) == (common["length"] if common else 0))


def on_grid(column: pa.Array, scale: int, shift: int) -> np.ndarray:
    """Vectors of one length as whole numbers ``floor(scale * entry) + shift``, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.floor(scale * flat)
    if len(values) and not np.abs(values).max() < FAR:
        raise ValueError("an entry is too large for the grid")
    return values.astype(np.int64).reshape(len(column), -1) + shift


def _in_rows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ranges(df: DataFrame, vector: str, scale: int, shift: int) -> list[tuple[int, int, int, int]]:
    """Count, exact sum, minimum and maximum of each dimension on the grid."""

    def run(batches):
        kept = None
        for batch in _in_rows(batches, ROWS):
            x = on_grid(batch.column(0), scale, shift)
            # Sums of at most 4096 numbers below 2^51 fit a word; they are carried on as Python's.
            part = [len(x), x.sum(axis=0).astype(object), x.min(axis=0), x.max(axis=0)]
            if kept is None:
                kept = part
            else:
                kept = [
                    kept[0] + part[0], kept[1] + part[1],
                    np.minimum(kept[2], part[2]), np.maximum(kept[3], part[3]),
                ]
        if kept is not None:
            dims = range(len(kept[2]))
            high = [int(s) >> LIMB for s in kept[1]]
            low = [int(s) & ((1 << LIMB) - 1) for s in kept[1]]
            yield pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array(dims, pa.int32()), "n": pa.array([kept[0]] * len(dims), pa.int64()),
                    "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64()),
                    "least": pa.array(kept[2]), "most": pa.array(kept[3]),
                }
            )

    schema = "dim int, n long, high long, low long, least long, most long"
    parts = df.select(vector).mapInArrow(run, schema)
    rows = (
        parts.groupBy("dim")
        .agg(*[F.sum(x).alias(x) for x in ("n", "high", "low")], F.min("least").alias("least"), F.max("most").alias("most"))
        .collect()
    )
    return [(r["n"], (r["high"] << LIMB) + r["low"], r["least"], r["most"]) for r in sorted(rows, key=lambda r: r["dim"])]


def bit_planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """The planes of columns of whole numbers from 0, as words across rows, ``bits`` of them for each column."""
    columns = np.ascontiguousarray(y.T)
    words = -(-len(y) // 64)
    out = np.zeros((sum(bits), words * 8), np.uint8)
    at = 0
    for column, b in zip(columns, bits):
        for k in range(b):
            packed = np.packbits(((column >> k) & 1).astype(np.uint8))
            out[at, : len(packed)] = packed
            at += 1
    return out.view(np.uint64)


def add_products(planes: np.ndarray, bits: list[int], limbs: np.ndarray) -> None:
    """Add the sums of products of each two dimensions to ``limbs``: limb, dimension, dimension.

    Population counts of the AND of two planes, weighted by both powers of two.
    The weight of a count is kept in the limb of its exponent.
    """
    first = np.concatenate(([0], np.cumsum(bits)))
    power = np.concatenate([np.arange(b) for b in bits]) if len(bits) else np.zeros(0, int)
    filled = np.flatnonzero(np.asarray(bits))  # a constant dimension has no plane: its products are 0
    for d in filled:
        later = filled[filled >= d]
        others, exponents = planes[first[d] :], power[first[d] :]
        starts = first[later] - first[d]
        for k in range(bits[d]):
            counts = np.bitwise_count(others & planes[first[d] + k]).sum(axis=1, dtype=np.int64)
            weight = exponents + k
            for limb in range(int(weight.min()) // LIMB, int(weight.max()) // LIMB + 1):
                inside = weight // LIMB == limb
                weighted = np.where(inside, counts << np.where(inside, weight % LIMB, 0), 0)
                limbs[limb, d, later] += np.add.reduceat(weighted, starts)


def scatter(df: DataFrame, vector: str, scale: int, shift: int, least: list[int], bits: list[int]) -> list[list[int]]:
    """Exact sums of products of the shifted dimensions, the upper triangle filled."""
    size, most = len(bits), 2 * max(bits, default=0)
    shifts = np.array(least, np.int64)
    keep = (1 << LIMB) - 1

    def run(batches):
        exact = np.zeros((size, size), object)
        limbs, held = np.zeros((most // LIMB + 1, size, size), np.int64), 0

        def settle():
            for i, limb in enumerate(limbs):
                exact[:] += limb.astype(object) << (LIMB * i)
            limbs[:] = 0

        some = False
        for batch in _in_rows(batches, ROWS):
            some = True
            add_products(bit_planes(on_grid(batch.column(0), scale, shift) - shifts, bits), bits, limbs)
            held += batch.num_rows
            if held > 1 << 24:  # 2^25 rows at most, times 2^30, times 53 pairs of planes of one weight
                settle()
                held = 0
        if not some:
            return
        settle()
        i, j = np.triu_indices(size)
        values, columns = exact[i, j], {"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32())}
        for k in range(LIMBS):
            last = k == LIMBS - 1
            columns[f"limb{k}"] = pa.array([(v >> (LIMB * k)) & (-1 if last else keep) for v in values], pa.int64())
        yield pa.RecordBatch.from_pydict(columns)

    schema = "i int, j int, " + ", ".join(f"limb{k} long" for k in range(LIMBS))
    parts = df.select(vector).mapInArrow(run, schema)
    out = [[0] * size for _ in range(size)]
    for row in parts.groupBy("i", "j").agg(*[F.sum(f"limb{k}").alias(f"limb{k}") for k in range(LIMBS)]).collect():
        out[row["i"]][row["j"]] = sum(row[f"limb{k}"] << (LIMB * k) for k in range(LIMBS))
    return out


#: Limbs of a task's sum: 2^106 a product and 2^44 rows.
LIMBS = 5


def fit(df: DataFrame, vector: str, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Fit:
    """Principal components of the covariance of usable vectors on the grid."""
    by_dim = ranges(df, vector, scale, shift)
    if not by_dim:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    n, sums, least = by_dim[0][0], [s for _, s, _, _ in by_dim], [x for _, _, x, _ in by_dim]
    bits = [(most - low).bit_length() for _, _, low, most in by_dim]
    products = scatter(df, vector, scale, shift, least, bits)
    moved = [s - n * low for s, low in zip(sums, least)]  # sums of the shifted numbers
    size = len(sums)
    cov = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            # Centred exactly; the one division of whole numbers rounds once.
            cov[i, j] = cov[j, i] = (n * products[i][j] - moved[i] * moved[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > RANK * max(values.max(initial=0.0), 0.0)]
    axes = vectors[:, order].T
    largest = np.argmax(np.abs(axes), axis=1)
    axes = axes * np.sign(axes[np.arange(len(axes)), largest])[:, None]
    return Fit(n, sums, axes, values[order], float(np.trace(cov)))


def squared_deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For each row the exact sum of ``(n * x - S)^2`` over dimensions."""
    if not x.size:
        return [0] * len(x)
    most = max(max(abs(n * int(b) - s), abs(n * int(a) - s)) for a, b, s in zip(x.min(axis=0), x.max(axis=0), sums))
    if most * most * len(sums) < 1 << 63 and n * int(np.abs(x).max()) < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return (d * d).sum(axis=1).tolist()


def whiten(
    df: DataFrame, key: str, vector: str, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """For each usable vector ``key, n, deviation, whitened``, and the fit's ``explained, identity_error``.

    ``whitened`` and ``explained`` are arrays, an entry for each component.
    ``deviation`` is an exact decimal.
    """
    rows = usable(df.select(key, vector), vector)
    found = fit(rows, vector, components, scale, shift)
    k = len(found.eigenvalues)
    axes = found.components / np.sqrt(found.eigenvalues)[:, None] if k else found.components
    id_type = df.schema[key].dataType.simpleString()
    base = np.array([s // found.n for s in found.sums], np.int64) if found.n else np.zeros(0, np.int64)
    rest = np.array([(s % found.n) / found.n for s in found.sums]) if found.n else np.zeros(0)

    def run(batches):
        for batch in _in_rows(batches, ROWS):
            x = on_grid(batch.column(1), scale, shift)
            white = ((x - base) - rest) @ axes.T  # whole part of the mean first: no digits are lost
            far = pa.array([str(v) for v in squared_deviations(x, found.n, found.sums)], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), far, lists], names=["key", "deviation", "whitened"])

    if not k:
        rows = rows.limit(0)
    done = rows.mapInArrow(run, f"key {id_type}, deviation string, whitened array<double>")
    done = cut_lineage(done.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    entry = [F.get("whitened", F.lit(i)) for i in range(k)]
    moments = [F.covar_pop(entry[i], entry[j]) for i, j in pairs]
    measured = done.agg(*moments).first() if k else []
    error = max((abs((v or 0.0) - (i == j)) for v, (i, j) in zip(measured, pairs)), default=0.0)
    return done.select(
        F.col("key").alias(key), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(float(e / found.trace)) for e in found.eigenvalues]).cast("array<double>").alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    numbered = done.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return numbered.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", F.col("deviation").cast("long").alias("deviation"),
        F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error",
    )
