"""Co-registered grids derived from the ``events`` table: one cell per event.

Cell ``(event_id div 100, event_id % 100)``; classes come in patches of 6 by 9
cells and shift over the years for cells whose event is a purchase or an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.codes import YEARS

CODES = [11, 21, 22, 23, 24, 31, 41, 42, 43, 52, 71, 81, 82, 90, 95]
CODES_1992 = [11, 21, 22, 23, 31, 32, 33, 41, 42, 43, 51, 61, 71, 81, 82, 83, 84, 85, 91, 92]
LAYERS = [f"lc_{y}" for y in YEARS]


def codes_of(k: int) -> list[int]:
    """Codes of year ``k``: the first year lacks 95, the last lacks 24."""
    out = list(CODES)
    if k == 0:
        out[14] = 90
    if k == 8:
        out[4] = 23
    return out


def _pick(values: list[int], index: str) -> str:
    return f"element_at(array({', '.join(map(str, values))}), CAST({index} AS INT) + 1)"


def _class_layer(k: int) -> str:
    moved = f"{k} > user_id % 9"
    shift = f"CASE WHEN event_type = 'purchase' AND {moved} THEN 5 WHEN event_type = 'error' AND {moved} THEN 3 ELSE 0 END"
    return f"CASE WHEN event_id % 97 = 0 THEN 0 ELSE {_pick(codes_of(k), f'(b + {shift}) % 15')} END"


_USER = "CASE WHEN event_type = 'signup' THEN user_id % 20 ELSE 0 END"
_EXPR = {name: _class_layer(k) for k, name in enumerate(LAYERS)} | {
    "lc_1992": _pick(CODES_1992, f"(b + {_USER}) % 20"),
    "impsur": "CASE WHEN event_id % 89 = 0 THEN 127 ELSE CAST(floor(value) AS INT) % 101 END",
    "canopy": "CASE WHEN event_id % 83 = 0 THEN 255 ELSE CAST(user_id % 101 AS INT) END",
    "chg": "CASE WHEN event_type IN ('purchase', 'error') THEN 11 ELSE 1 END",
}


def stack(spark: SparkSession, sf_dir: str, *layers: str) -> DataFrame:
    """One row per cell with the named layers (all of them by default)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ev = ev.selectExpr("*", "event_id div 100 AS r", "event_id % 100 AS c")
    ev = ev.selectExpr("*", "(r div 6) * 7 + (c div 9) * 11 AS b")
    return ev.selectExpr("r", "c", *[f"{_EXPR[n]} AS {n}" for n in (layers or _EXPR)])


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One grid as ``r, c, v``."""
    return stack(spark, sf_dir, name).withColumnRenamed(name, "v")


def cells(spark: SparkSession, sf_dir: str, *layers: str) -> DataFrame:
    """Several grids in the long form ``layer, year, r, c, v``; one scan feeds all."""
    layers = layers or tuple(LAYERS)
    long = stack(spark, sf_dir, *layers).unpivot(["r", "c"], list(layers), "layer", "v")
    return long.select("layer", F.substring("layer", 4, 4).cast("int").alias("year"), "r", "c", "v")


def forest_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest cells of the first year; a feature is a band of 25 columns."""
    g = layer(spark, sf_dir, "lc_2001").filter(F.col("v").isin(41, 42, 43))
    return g.select(F.call_function("div", "c", F.lit(25)).alias("feat_id"), "r", "c")


def study_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study area as a mask grid: all but the outermost columns."""
    return stack(spark, sf_dir, "lc_2001").filter(F.col("c").between(3, 96)).select("r", "c")
