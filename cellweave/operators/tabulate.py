"""Attribute tables, totals, shares, yearly summaries and their reshapes.

Cells are aggregated to counts per code first; everything after works on a few
hundred rows, so its windows, sorts and pivots are small whatever the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.functions.columns import (
    area_ac,
    area_ha,
    col,
    cover_class,
    pct_change,
    pct_label,
)
from cellweave.session import broadcast_if_small


def build_rat(cells: DataFrame, *keys: str) -> DataFrame:
    """Cell count per value, NoData excluded."""
    return cells.filter(F.col("v").isNotNull()).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))


def layer_stats(cells: DataFrame) -> DataFrame:
    return cells.groupBy("layer").agg(
        F.min("v").alias("min_v"),
        F.max("v").alias("max_v"),
        F.avg("v").alias("mean_v"),
        F.stddev_pop("v").alias("std_v"),
    )


def total_cells(rat: DataFrame) -> DataFrame:
    return rat.agg(F.sum("n").alias("total"))


def conditional_total(rat: DataFrame, codes: list[int]) -> DataFrame:
    return rat.agg(F.sum(F.when(F.col("v").isin(codes), F.col("n"))).alias("total"))


def share(n="n", *keys: str, where: Column | None = None) -> Column:
    """Percentage of the total count; with ``where`` of and for those rows only."""
    w = W.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    if where is None:
        return col(n) / F.sum(col(n)).over(w) * 100
    return F.when(where, col(n) / F.sum(F.when(where, col(n))).over(w) * 100)


def calculate_field(df: DataFrame, name: str, expression: str) -> DataFrame:
    """A column computed by any SQL expression, registered functions included."""
    return df.withColumn(name, F.expr(expression))


def freq_table(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("freq"))


def unique_values(df: DataFrame, field: str) -> DataFrame:
    return df.select(field).distinct().orderBy(field)


def tab_to_dict(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key; of repeated keys the last by ``order`` wins."""
    return df.groupBy(F.col(key).alias("key")).agg(F.max_by(value, order).alias("value"))


def join_field(left: DataFrame, right: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Left join of selected fields on a unique key."""
    return left.join(right.select(on, *fields), on, "left")


def join_field_first(left: DataFrame, right: DataFrame, on: str, key: str, field: str) -> DataFrame:
    """Left join to a repeated key without fan-out.

    All rows of a key carry the same label, so the smallest is the first.
    """
    first = right.groupBy(F.col(key).alias(on)).agg(F.min(field).alias(field))
    return left.join(first, on, "left")


def reclass_by_table(cells: DataFrame, table: DataFrame, src: str = "v", dst: str = "reclass") -> DataFrame:
    """Remap codes by a table of unique codes; codes it lacks become NoData.

    Codes are few and each fills much of a grid, so the table is broadcast if
    its count allows and cells are not shuffled by code.
    """
    table = broadcast_if_small(table.select(F.col(src).alias("v"), F.col(dst).alias("_to")))
    return cells.join(table, "v", "left").withColumn("v", F.col("_to")).drop("_to")


def class_combos(stack: DataFrame, t1: str, t2: str) -> DataFrame:
    """Every pair of a class of one date and a class of another, with its code.

    The two class lists come from one aggregate; a schema has a few dozen codes,
    so both lists fit a row.
    """
    sets = stack.agg(F.collect_set(t1).alias("a"), F.collect_set(t2).alias("b"))
    pairs = sets.select(F.explode("a").alias("start_class"), "b").select(
        "start_class", F.explode("b").alias("end_class")
    )
    return pairs.select((F.col("start_class") * 100 + F.col("end_class")).alias("code"), "start_class", "end_class")


def occurring_combos(stack: DataFrame, t1: str, t2: str) -> DataFrame:
    """The pairs of classes of two dates that some cell has, with their code."""
    pairs = stack.select(F.col(t1).alias("start_class"), F.col(t2).alias("end_class")).distinct()
    code = F.col("start_class") * 100 + F.col("end_class")
    return pairs.select(code.alias("code"), "start_class", "end_class").filter("code is not null")


def lookup_first(codes: DataFrame, combos: DataFrame) -> DataFrame:
    """Row of the combination list for each code; a code without one is an error."""
    missing = F.raise_error(F.concat(F.lit("no combination for code "), F.col("code").cast("string")))
    one = combos.groupBy("code").agg(F.min(F.struct("start_class", "end_class")).alias("x"))
    found = F.when(F.col("x").isNotNull(), F.col("x")).otherwise(missing)
    return codes.join(one, "code", "left").withColumn("x", found).select(
        *codes.columns, "x.start_class", "x.end_class"
    )


def pivot_years(rat: DataFrame, years: list[int]) -> DataFrame:
    """``v`` with percent, hectares and acres per year from ``year, v, n``.

    Percentages refer to the total of the year given first.
    """
    first = F.sum(F.when(F.col("year") == years[0], F.col("n"))).over(W.partitionBy(F.lit(0)))
    rat = rat.filter(F.col("year").isin(years)).withColumn("total", first)
    wide = rat.groupBy("v", "total").pivot("year", years).agg(F.first("n", ignorenulls=True))
    out = [F.col("v")]
    for y in years:
        cnt = F.col(str(y))
        out += [
            (cnt * 100 / F.col("total")).alias(f"Percent_{y}"),
            area_ha(cnt).alias(f"Area_ha_{y}"),
            area_ac(cnt).alias(f"Area_ac_{y}"),
        ]
    return wide.select(*out)


def tab_lc_types(rat: DataFrame, years: list[int], schema: str | None = None) -> DataFrame:
    """Percent, hectares and acres per class and year, and first-to-last change.

    ``rat`` is ``year, v, n``. Percentages of every year refer to the total of
    the year given first, whose classes are the rows: a class it lacks is
    dropped, one missing later is null. Change runs from the earliest to the
    latest year.
    """
    wide = pivot_years(rat, years).filter(F.col(f"Percent_{years[0]}").isNotNull())
    if schema:
        wide = wide.withColumn("CoverClass", cover_class("v", schema))
    a, b = min(years), max(years)
    ha = F.col(f"Area_ha_{b}") - F.col(f"Area_ha_{a}")
    return wide.withColumns(
        {
            "Change_ha": ha,
            "Change_ac": F.col(f"Area_ac_{b}") - F.col(f"Area_ac_{a}"),
            "Change_perc": ha * 100 / F.col(f"Area_ha_{a}"),
        }
    )


def unpivot_area(summary: DataFrame) -> DataFrame:
    """Area columns of a yearly summary as rows ``v, CoverClass, name, Area_ha, year``."""
    areas = [c for c in summary.columns if c.startswith("Area_ha_")]
    long = summary.unpivot(["v", "CoverClass"], areas, "name", "Area_ha")
    return long.withColumn("year", F.right("name", F.lit(4)).cast("int"))


def lag_pct_change(long: DataFrame) -> DataFrame:
    """Change against the year before within a class, and its label."""
    before = F.lag("Area_ha").over(W.partitionBy("v").orderBy("year"))
    out = long.withColumn("pct_change", pct_change(F.col("Area_ha"), before))
    return out.withColumn("label", pct_label("pct_change"))


def class_period_stats(long: DataFrame) -> DataFrame:
    """Per class: median year and area, last minus first, percent change and label.

    A class that lacks a year has no median area.
    """
    whole = F.count("Area_ha") == F.count(F.lit(1))
    first, last = F.min_by("Area_ha", "year"), F.max_by("Area_ha", "year")
    out = long.groupBy("CoverClass").agg(
        F.median("year").alias("x"),
        F.when(whole, F.median("Area_ha")).alias("y"),
        (last - first).alias("area_change"),
        pct_change(last, first).alias("pct_change"),
    )
    return out.withColumn("label", pct_label("pct_change"))


def class_order(stats: DataFrame) -> DataFrame:
    """Classes by median area, largest first, as an order column."""
    w = W.orderBy(F.desc("y"), "CoverClass")
    return stats.select("CoverClass", "y", F.row_number().over(w).alias("ord"))


def year_pairs(years: DataFrame) -> DataFrame:
    """Consecutive years, and the first with the last."""
    years = years.select("year").distinct()
    nxt = F.lead("year").over(W.orderBy("year"))
    steps = years.select(F.col("year").alias("y1"), nxt.alias("y2")).filter("y2 IS NOT NULL")
    span = years.agg(F.min("year").alias("y1"), F.max("year").alias("y2")).filter("y1 < y2")
    return steps.union(span).distinct()


def general_trend(summary: DataFrame) -> DataFrame:
    """Year series of the five main general classes in millions of hectares."""
    long = unpivot_area(summary).filter(F.col("v").between(1, 5))
    return long.select("v", "CoverClass", "year", (F.col("Area_ha") / F.lit(1e6)).alias("millions"))
