"""Yearly landscape: barren chain, general classes, table and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.functions.columns import cover_class, forest_change, reclass
from cellweave.model import GridSpec
from cellweave.operators.overlay import polygon_mask
from cellweave.operators.tabulate import (
    build_rat,
    class_period_stats,
    lag_pct_change,
    tab_lc_types,
    unpivot_area,
)
from cellweave.plans.barren import TILE, barren_chain


def general_stack(stack: DataFrame, layers: list[str]) -> DataFrame:
    """A stack of general classes under the same layer names."""
    return stack.select("r", "c", *[reclass(x, codes.TO_GENERAL).alias(x) for x in layers])


def yearly_rat(stack: DataFrame, layers: list[str]) -> DataFrame:
    """``year, v, n`` of layers named by year, in one scan."""
    pairs = ", ".join(f"{name[3:7]}, {name}" for name in layers)
    return build_rat(stack.selectExpr(f"stack({len(layers)}, {pairs}) AS (year, v)"), "year")


def general_summary(stack: DataFrame, years: list[int], layer: str = "lc_{}") -> DataFrame:
    """Yearly table of the general classes with their names."""
    layers = [layer.format(y) for y in years]
    return tab_lc_types(yearly_rat(general_stack(stack, layers), layers), years, "Gen")


def general_change_trend(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Yearly series with change labels, and the full-period change per class."""
    long = unpivot_area(summary)
    return lag_pct_change(long), class_period_stats(long)


def landscape_run(
    stack: DataFrame,
    years: list[int],
    edges: DataFrame | None = None,
    spec: GridSpec = GridSpec(),
    tile: int = TILE,
) -> DataFrame:
    """From the raw layers to the yearly table of general classes.

    The 1992 layer is cut to the cells of the first layer. The table counts the
    cells inside a polygon, if one is given.
    """
    first = F.col(f"lc_{years[0]}").isNotNull()
    split = barren_chain(stack.withColumn("lc_1992", F.when(first, F.col("lc_1992"))), years, tile=tile)
    if edges is not None:
        split = polygon_mask(split, edges, spec)
    renamed = split.select("r", "c", *[F.col(f"b_{y}").alias(f"lc_{y}") for y in years])
    return general_summary(renamed, years)


def disturbance_run(stack: DataFrame, years: list[int], product: str = "chg") -> DataFrame:
    """The yearly table of general classes in which disturbed forest is told apart."""
    marked = stack.select("r", "c", *[forest_change(f"lc_{y}", product).alias(f"lc_{y}") for y in years])
    return general_summary(marked, years)


def labelled(cells: DataFrame, schema: str) -> DataFrame:
    return cells.withColumn("CoverClass", cover_class("v", schema))
