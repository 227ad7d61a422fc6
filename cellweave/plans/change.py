"""Two-date change: code tables, summaries, loss and gain.

Cells are counted per change code once, for all periods in one scan; classes,
names, areas and shares are worked out on the few hundred codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.functions.columns import (
    area_ha_900,
    change_code,
    change_type,
    col,
    concat_code,
    cover_class,
    decade,
    decade_label,
    decade_order,
    end_class,
    merge_successional,
    period_group,
    start_class,
    summary_code,
    summary_label,
)
from cellweave.model import GridSpec
from cellweave.operators.overlay import extract_by_mask, polygon_mask
from cellweave.operators.tabulate import build_rat, share


def change_cells(stack: DataFrame, t1: str, t2: str, mask: DataFrame | None = None) -> DataFrame:
    """Change grid of two layers of a stack; the mask is optional."""
    if mask is not None:
        stack = extract_by_mask(stack, mask)
    return stack.select("r", "c", change_code(t1, t2).alias("v"))


def change_counts(
    stack: DataFrame, periods: list[tuple[int, int]], layer: str = "lc_{}", stored: DataFrame | None = None
) -> DataFrame:
    """``period, v, n`` of every period from one scan of the stack.

    Periods that ``stored`` holds already are taken from it and not counted again.
    """
    if stored is not None:
        done = {row["period"] for row in stored.select("period").distinct().collect()}  # names of periods
        left = [p for p in periods if "{}-{}".format(*p) not in done]
        kept = stored.select("period", "v", "n")
        return kept.unionByName(change_counts(stack, left, layer)) if left else kept
    names = [f"c{i}" for i in range(len(periods))]
    coded = stack.select(
        *[change_code(layer.format(a), layer.format(b)).alias(n) for n, (a, b) in zip(names, periods)]
    )
    pairs = ", ".join(f"'{a}-{b}', {n}" for n, (a, b) in zip(names, periods))
    return build_rat(coded.selectExpr(f"stack({len(periods)}, {pairs}) AS (period, v)"), "period")


def change_decode(rat: DataFrame, schema: str = "NLCD") -> DataFrame:
    """Start and end class, their names and the change type of each code."""
    return (
        rat.withColumns({"start_class": start_class("v"), "end_class": end_class("v")})
        .withColumns(
            {
                "start_class_name": cover_class("start_class", schema),
                "end_class_name": cover_class("end_class", schema),
            }
        )
        .withColumn(
            "change_type", change_type("start_class", "end_class", "start_class_name", "end_class_name")
        )
    )


def change_rast(stack: DataFrame, t1: str, t2: str, mask: DataFrame | None = None, schema: str = "NLCD") -> DataFrame:
    """Attribute table of the change grid with classes, area and share."""
    rat = change_decode(build_rat(change_cells(stack, t1, t2, mask)), schema)
    return rat.withColumns({"area_ha": area_ha_900("n"), "perc_total": share("n")})


def change_run(
    stack: DataFrame,
    periods: list[tuple[int, int]],
    edges: DataFrame | None = None,
    spec: GridSpec = GridSpec(),
    schema: str = "NLCD",
    layer: str = "lc_{}",
) -> DataFrame:
    """The change tables of all periods, with classes, area and share, from one scan inside a polygon."""
    if edges is not None:
        stack = polygon_mask(stack, edges, spec)
    rat = change_decode(change_counts(stack, periods, layer), schema)
    return rat.withColumns({"area_ha": area_ha_900("n"), "perc_total": share("n", "period")})


def change_summary(
    rat: DataFrame,
    from_cls: list[int],
    from_name: str,
    to_cls: list[int],
    to_name: str,
    backwards: bool = True,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Cells per summary code, with label, area and share of the first date's class.

    ``keys`` name what is summed up apart, as periods.
    """
    code = summary_code(start_class("v"), end_class("v"), from_cls, to_cls, backwards)
    out = rat.groupBy(*keys, code.alias("v")).agg(F.sum("n").alias("n"))
    return out.withColumns(
        {
            "class": summary_label("v", from_name, to_name, backwards),
            "area_ha": area_ha_900("n"),
            "perc_of_t1_area": share("n", *keys, where=F.col("v").isin(1, 2, 3)),
        }
    )


def change_summary_cells(
    change: DataFrame, from_cls: list[int], to_cls: list[int], backwards: bool = True
) -> DataFrame:
    """The class grid behind a change summary."""
    code = summary_code(start_class("v"), end_class("v"), from_cls, to_cls, backwards)
    return change.select("r", "c", code.alias("v"))


def _to_from_code(start, end, cls: list[int]):
    s, e, first = col(start).isin(cls), col(end).isin(cls), F.lit(cls[0])
    code = F.when(s & e, 1).when(s, concat_code(first, end)).when(e, concat_code(start, first))
    return code.otherwise(0)


def change_to_from_cells(change: DataFrame, cls: list[int]) -> DataFrame:
    """The class grid behind the table of moves to and from a class; NoData stays."""
    code = _to_from_code(start_class("v"), end_class("v"), cls)
    return change.select("r", "c", F.when(F.col("v").isNotNull(), code).cast("int").alias("v"))


def to_from_table(rat: DataFrame, cls: list[int], name: str, schema: str = "NLCD") -> DataFrame:
    """New code ``reclass`` and change type of each change code.

    Codes join the digits of the first studied class and of the other class.
    """
    d = change_decode(rat, schema)
    s, e = F.col("start_class").isin(cls), F.col("end_class").isin(cls)
    return d.withColumns(
        {
            "reclass": _to_from_code("start_class", "end_class", cls),
            "change_type": F.when(s & e, F.lit(codes.STAYED_IN.format(a=name)))
            .when(s, F.concat(F.lit(f"{name} to "), "end_class_name"))
            .when(e, F.concat("start_class_name", F.lit(f" to {name}")))
            .otherwise(F.lit(codes.STAYED_OUT.format(a=name))),
        }
    )


def change_to_from(rat: DataFrame, cls: list[int], name: str, schema: str = "NLCD") -> DataFrame:
    """Moves to and from a class: count, type, area and share of all cells."""
    table = to_from_table(rat, cls, name, schema)
    out = table.groupBy(F.col("reclass").alias("v")).agg(
        F.sum("n").alias("n"),
        F.min("change_type").alias("change_type"),  # the same for all of a code
    )
    return out.withColumns({"area_ha": area_ha_900("n"), "perc_area": share("n")})


def loss_gain_filter(rat: DataFrame, cls: list[int], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Codes that enter or leave a class, without the excluded periods."""
    s, e = F.col("start_class").isin(cls), F.col("end_class").isin(cls)
    out = rat.filter(s != e)
    return out.filter(~F.col("period").isin(list(exclude))) if exclude else out


def period_class_area(rat: DataFrame, cls: list[int], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Cells and hectares by decade of start and end class and period."""
    rat = rat.withColumns({"start_class": start_class("v"), "end_class": end_class("v")})
    rat = rat.withColumns(
        {"start_class": merge_successional("start_class"), "end_class": merge_successional("end_class")}
    )
    return (
        loss_gain_filter(rat, cls, exclude)
        .groupBy(
            decade("start_class", cls).alias("gen_start"),
            decade("end_class", cls).alias("gen_end"),
            F.col("period").alias("chg_years"),
        )
        .agg(F.sum("n").alias("n"))
        .withColumn("hectares", area_ha_900("n"))
    )


def loss_gain(rat: DataFrame, cls: list[int], name: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Hectares lost to and gained from each decade class, by period."""
    out = period_class_area(rat, cls, exclude)
    lost = F.col("gen_start") == "99"
    other = F.when(lost, F.col("gen_end")).otherwise(F.col("gen_start"))
    return out.withColumns(
        {
            "to_from": F.when(lost, F.lit("Loss")).otherwise(F.lit("Gain")),
            "chg_class": decade_label(other, name),
            "ord": decade_order(other),
        }
    )


def net_change(rat: DataFrame, cls: list[int], name: str, full: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Gain minus loss in hectares by period and decade class."""
    signed = F.when(F.col("to_from") == "Loss", -F.col("n")).otherwise(F.col("n"))
    return (
        loss_gain(rat, cls, name, exclude)
        .groupBy("chg_years", "chg_class")
        .agg(F.sum(signed).alias("n"))
        .select("chg_years", "chg_class", area_ha_900("n").alias("ha"), period_group("chg_years", full).alias("grp"))
    )


def forest_developed(rat: DataFrame, backwards: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """The change summary of forest against developed classes."""
    return change_summary(rat, codes.FOREST, "Forest", codes.DEVELOPED, "Developed", backwards, keys)
