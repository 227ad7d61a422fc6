"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic). Raking scales the cells to
each target marginal in turn, until all marginals hold; a document's weight is
its cell's fitted share over its share of the corpus. Documents are then sampled
by calibrated probabilities: proportional to weight, never above 1, and scaled
so that the expected number of tokens is a given part of the corpus.

Counting, raking and calibration are Spark aggregations over the table of
cells; the driver sees residuals and sums only. Whether a document is drawn
depends on a hash of its id and text, so a repeated run draws the same.

Defined results: null source or language, or a null topic, is the value
``(none)``; null text has no tokens, and a cell without tokens keeps weight 1.
Ties cannot matter, as every row is drawn on its own; repeated rows are drawn
together. A target value that the corpus lacks is left out, and a corpus value
that the target lacks keeps its present share. An empty table gives an empty
result. Columns of the input named like those added are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.registry import query
from cellweave.llm.text import WORD, table
from cellweave.session import broadcast_if_small, cut_lineage, remove_step, write_step

NONE = "(none)"
#: Powers that flatten the present shares of a dimension to its target shares.
TEMPERS = {"source": 0.7, "lang": 0.7, "topic": 0.8}
#: Expected part of the corpus's tokens that is drawn.
KEEP = 0.8
TOLERANCE = 1e-6
ROUNDS = 30
#: Up to this many cells (groups by source, language and topic) are raked in numpy.
CELLS = 100_000


def topic_of(text: Column) -> Column:
    """A topic by the form of a text, decided over the whole of it."""
    raw = F.coalesce(text, F.lit(""))
    return (
        F.when(raw.rlike("(?i)licen[cs]e"), "licence")
        .when(raw.contains("@"), "contact")
        .when(raw.contains(" | "), "table")
        .when(raw.rlike("[0-9]{4}"), "figures")
        .when(F.length(raw) < 500, "note")
        .when(F.length(raw) < 4000, "article")
        .otherwise("long")
    )


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of a dimension: the present ones, raised to a power."""
    present = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("n")).filter("n > 0")
    total = present.agg(F.sum(F.pow("n", F.lit(power))).alias("t"), F.lit(1).alias("one"))
    scale = (total.first() or [None])[0] or 1.0
    return present.select("value", (F.pow("n", F.lit(power)) / scale).alias("share"))


def wanted_shares(cells: DataFrame, dim: str, target: DataFrame) -> DataFrame:
    """``dim, _share``: what each present value of a dimension is to have of all tokens."""
    present = cells.groupBy(dim).agg(F.sum("fitted").alias("_now"))
    both = present.join(target.select(F.col("value").alias(dim), "share"), dim, "left")
    # Values without a target keep what they have; the others share the rest.
    held = F.sum(F.when(F.col("share").isNull(), F.col("_now")).otherwise(0.0))
    asked = F.sum(F.when(F.col("_now") > 0, F.col("share")))
    sums = both.agg(held, asked).first()
    rest, asked = 1 - (sums[0] or 0.0), sums[1] or 1.0
    share = F.when(F.col("share").isNull(), F.col("_now")).otherwise(F.col("share") * (rest / asked))
    return both.select(dim, share.alias("_share"))


def rake(
    cells: DataFrame,
    targets: dict[str, DataFrame],
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
    limit: int = CELLS,
) -> DataFrame:
    """``cells`` with ``fitted``, their share of tokens once every marginal has its target shares.

    ``cells`` has a column for each dimension and ``tokens``; ``targets`` has
    ``value, share`` for each dimension. Cells are groups of documents; up to
    ``limit`` of them are raked in numpy, more in Spark, by the same steps. A
    round ends the raking if no marginal was off by more than ``tolerance``
    when it was its turn.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    fitted, held = write_step(cells.withColumn("fitted", F.col("tokens") / float(total)))
    wanted = {dim: wanted_shares(fitted, dim, target) for dim, target in targets.items()}
    if fitted.count() <= limit:
        return cells.sparkSession.createDataFrame(
            _raked(fitted.toArrow(), {dim: share.toArrow() for dim, share in wanted.items()}, rounds, tolerance), fitted.schema
        )
    wanted = {dim: cut_lineage(share) for dim, share in wanted.items()}
    for _ in range(rounds):
        error = 0.0
        for dim, target in wanted.items():
            now = fitted.groupBy(dim).agg(F.sum("fitted").alias("_now")).join(target, dim)
            factor = F.when(F.col("_now") > 0, F.col("_share") / F.col("_now")).otherwise(1.0)
            gap = F.abs(F.col("_now") - F.col("_share"))
            now, factors = write_step(now.select(dim, factor.alias("_factor"), gap.alias("_gap")))
            error = max(error, now.agg(F.max("_gap")).first()[0] or 0.0)
            after = fitted.join(now.select(dim, "_factor"), dim).withColumn("fitted", F.col("fitted") * F.col("_factor"))
            before, (fitted, held) = held, write_step(after.select(*cells.columns, "fitted"))
            for path in (before, factors):
                remove_step(cells.sparkSession, path)
        if error <= tolerance:
            break
    return fitted


def _raked(cells: pa.Table, wanted: dict[str, pa.Table], rounds: int, tolerance: float) -> pa.Table:
    fitted = cells["fitted"].to_numpy().copy()
    dims = []
    for dim, table in wanted.items():
        place = {v: i for i, v in enumerate(table[dim].to_pylist())}
        dims.append((np.array([place[v] for v in cells[dim].to_pylist()], np.int64), table["_share"].to_numpy()))
    for _ in range(rounds):
        error = 0.0
        for at, share in dims:
            now = np.bincount(at, weights=fitted, minlength=len(share))
            error = max([error, *np.abs(now - share)])
            fitted *= np.divide(share, now, out=np.ones(len(share)), where=now > 0)[at]
        if error <= tolerance:
            break
    return cells.set_column(cells.schema.get_field_index("fitted"), "fitted", pa.array(fitted))


def calibrate(cells: DataFrame, keep: float = KEEP, limit: int = CELLS) -> float:
    """The rate at which probabilities ``min(1, rate * weight)`` draw a part ``keep`` of the tokens.

    ``cells`` has ``tokens`` and ``weight``. Each pass tries 64 rates at once.
    """
    total, low, rows = cells.agg(F.sum("tokens"), F.min(F.when(F.col("tokens") > 0, F.col("weight"))), F.count("*")).first()
    if not total or not low or keep >= 1:
        return float("inf") if keep >= 1 else keep
    if rows <= limit:
        table = cells.select("tokens", "weight").toArrow()
        tokens, weight = (table[x].to_numpy().astype(float) for x in ("tokens", "weight"))

        def drawn(rates):
            return [float((tokens * np.minimum(1.0, weight * r)).sum()) for r in rates]
    else:

        def drawn(rates):
            sums = [F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * float(r))) for r in rates]
            return list(cells.agg(*[x.alias(f"r{i}") for i, x in enumerate(sums)]).first())

    lo, hi = 0.0, max(1.0, 1.0 / low)
    for _ in range(5):
        rates = np.linspace(lo, hi, 64)
        i = int(np.searchsorted(np.array(drawn(rates), float), keep * total))
        lo, hi = float(rates[max(i - 1, 0)]), float(rates[min(i, 63)])
    return hi


def mix(
    docs: DataFrame,
    topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None,
    keep: float = KEEP,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
) -> DataFrame:
    """``docs`` with ``topic, tokens, weight, probability, sampled``."""
    added = ["_source", "_lang", "topic", "tokens", "weight", "probability", "sampled"]
    topic = topic_of(F.col(text)) if topic is None else topic

    def value(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(NONE))

    named = docs.drop(*[c for c in added if c not in (doc_id, text, source, lang)]).withColumns(
        {
            "_source": value(F.col(source)),
            "_lang": value(F.col(lang)),
            "_topic": value(topic),
            "tokens": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long"),
        }
    )
    dims = ["_source", "_lang", "_topic"]
    cells = cut_lineage(
        named.groupBy(*dims).agg(F.sum("tokens").alias("tokens"))
    ).withColumnsRenamed({"_source": "source", "_lang": "lang", "_topic": "topic"})
    if targets is None:
        targets = {dim: tempered(cells, dim, power) for dim, power in TEMPERS.items()}
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    share = F.col("tokens") / float(total)
    weight = F.when(F.col("tokens") > 0, F.col("fitted") / share).otherwise(1.0)
    fitted = cut_lineage(rake(cells, targets).withColumn("weight", weight))
    rate = calibrate(fitted, keep)
    chance = F.least(F.lit(1.0), F.col("weight") * min(rate, 1e300))
    probable = broadcast_if_small(
        fitted.select(
            F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("topic").alias("_topic"),
            "weight", chance.alias("probability"),
        )
    )
    draw = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text), F.lit("mix"))
    uniform = F.shiftrightunsigned(draw, 11) / float(1 << 53)
    return (
        named.join(probable, dims)
        .withColumn("sampled", uniform < F.col("probability"))
        .withColumnRenamed("_topic", "topic")
        .drop("_source", "_lang")
    )


def sample(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``mix`` draws, with their own columns."""
    return mix(docs, **options).filter("sampled").select(*docs.columns)


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled"
    )
