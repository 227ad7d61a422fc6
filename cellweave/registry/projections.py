"""Projections, filters and reclassification."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.functions import columns as col
from cellweave.operators import overlay
from cellweave.operators.tabulate import build_rat, reclass_by_table
from cellweave.operators.tabulate import calculate_field as calculate
from cellweave.plans.change import (
    change_counts,
    change_decode,
    change_summary_cells,
    change_cells,
    change_to_from,
    loss_gain_filter,
)
from cellweave.plans.landscape import labelled
from cellweave.plans.proportions import indicator_stack
from cellweave.registry.base import DETAILED, GENERAL, in_sql, query, remap_sql, sql
from cellweave.registry.scans import stored
from cellweave.sources import events_grid as grid


def _register(name, layer, expr, sql_expr):
    """A query that recomputes ``v`` of one layer; ``expr`` runs once a session exists."""

    def run(spark, d):
        return grid.layer(spark, d, layer).withColumn("v", expr())

    query(name, sql(f"SELECT r, c, CAST({sql_expr} AS INTEGER) AS v FROM stack"))(run)


_SOME = {0: None, 11: 1, 21: 2, 31: 7}
_register("reclass_passthrough", "lc_2001", lambda: col.reclass("v", _SOME), remap_sql("lc_2001", _SOME))
_register("reclass_strict", "lc_2001", lambda: col.reclass("v", _SOME, False), remap_sql("lc_2001", _SOME, False))
_register(
    "transition_1992",
    "lc_1992",
    lambda: col.reclass("v", codes.BARREN_FROM_1992),
    remap_sql("lc_1992", codes.BARREN_FROM_1992),
)
_register(
    "transition_standard",
    "lc_2001",
    lambda: col.reclass("v", codes.BARREN_FROM_STANDARD),
    remap_sql("lc_2001", codes.BARREN_FROM_STANDARD),
)
_register("keep_only_class", "lc_1992", lambda: col.keep_only("v", 32), "CASE WHEN lc_1992 = 32 THEN 32 END")
_register(
    "null_to_zero",
    "lc_2001",
    lambda: col.null_to_zero(col.reclass("v", codes.TO_GENERAL)),
    f"coalesce({remap_sql('lc_2001', codes.TO_GENERAL)}, 0)",
)


@query(
    "reclass_by_table",
    sql(
        "SELECT s.r, s.c, t.dst AS v FROM (SELECT r, c, lc_2001 * 100 + lc_2021 AS code FROM stack) s "
        "LEFT JOIN (SELECT DISTINCT lc_2001 * 100 + lc_2021 AS src, CAST(CASE "
        f"WHEN lc_2001 IN {in_sql(codes.FOREST)} AND lc_2021 IN {in_sql(codes.FOREST)} THEN 1 "
        f"WHEN lc_2001 IN {in_sql(codes.FOREST)} AND lc_2021 IN {in_sql(codes.DEVELOPED)} THEN 2 "
        f"WHEN lc_2001 IN {in_sql(codes.FOREST)} THEN 3 "
        f"WHEN lc_2021 IN {in_sql(codes.FOREST)} THEN 4 ELSE 0 END AS INTEGER) AS dst FROM stack) t "
        "ON s.code = t.src"
    ),
)
def reclass_by_table_query(spark, d):
    """The class grid of a change summary: codes are classed in the attribute table, cells by that."""
    change = change_cells(grid.stack(spark, d, "lc_2001", "lc_2021"), "lc_2001", "lc_2021")
    start, end = col.start_class("v"), col.end_class("v")
    code = col.summary_code(start, end, codes.FOREST, codes.DEVELOPED, backwards=False)
    return reclass_by_table(change, build_rat(change).withColumn("reclass", code)).select("r", "c", "v")


@query(
    "reclass_general",
    sql(
        "SELECT g.r, g.c, g.v, n.label AS CoverClass FROM "
        f"(SELECT r, c, {remap_sql('lc_2021', codes.TO_GENERAL)} AS v FROM stack) g "
        "LEFT JOIN general n ON g.v = n.code",
        GENERAL,
    ),
)
def reclass_general(spark, d):
    g = grid.layer(spark, d, "lc_2021").withColumn("v", col.reclass("v", codes.TO_GENERAL))
    return labelled(g, "Gen")


def _indicator_sql(name):
    table = {k: codes.INDICATORS[name].get(k, 0) for k in codes.INDICATOR_CODES}
    return remap_sql("lc_2001", table, False)


INDICATOR_SQL = ", ".join(f"{_indicator_sql(k)} AS {k}" for k in codes.INDICATORS)
_NAMES = list(codes.INDICATORS)


@query(
    "indicator_layers",
    sql(
        f"SELECT r, c, layer, v FROM (SELECT r, c, {INDICATOR_SQL} FROM stack) "
        f"UNPIVOT INCLUDE NULLS (v FOR layer IN ({', '.join(_NAMES)}))"
    ),
)
def indicator_layers(spark, d):
    wide = indicator_stack(grid.stack(spark, d, "lc_2001"), "lc_2001")
    return wide.unpivot(["r", "c"], _NAMES, "layer", "v")


@query(
    "set_null",
    sql(
        "SELECT r, c, nullif(lc_2001, 0) AS lc_2001, nullif(impsur, 127) AS impsur, "
        "nullif(canopy, 255) AS canopy, nullif(canopy, 0) AS canopy_loop FROM stack"
    ),
)
def set_null(spark, d):
    return grid.stack(spark, d, "lc_2001", "impsur", "canopy").select(
        "r",
        "c",
        col.set_null("lc_2001", codes.CLASS_NODATA).alias("lc_2001"),
        col.set_null("impsur", codes.IMPERVIOUS_NODATA).alias("impsur"),
        col.set_null("canopy", codes.CANOPY_NODATA).alias("canopy"),
        col.set_null("canopy", 0).alias("canopy_loop"),
    )


@query(
    "map_algebra_con",
    sql(
        "SELECT r, c, CASE WHEN a.lc_2021 = 31 THEN CASE WHEN b.lc_2001 = 31 THEN 31 ELSE 32 END "
        "ELSE a.lc_2021 END AS v FROM stack a JOIN stack b USING (r, c)"
    ),
)
def map_algebra_con(spark, d):
    g = overlay.overlay_join({"t1": grid.layer(spark, d, "lc_2001"), "t2": grid.layer(spark, d, "lc_2021")})
    v = F.when(F.col("t2") == 31, F.when(F.col("t1") == 31, 31).otherwise(32)).otherwise(F.col("t2"))
    return g.select("r", "c", v.alias("v"))


@query(
    "forest_change",
    sql(
        "SELECT g.r, g.c, g.v, n.label AS CoverClass FROM (SELECT r, c, CASE WHEN lc_2011 IN (52, 71) "
        "AND chg = 11 THEN lc_2011 + 4 ELSE lc_2011 END AS v FROM stack SEMI JOIN mask USING (r, c)) g "
        "LEFT JOIN detailed n ON g.v = n.code",
        DETAILED,
    ),
)
def forest_change(spark, d):
    g = overlay.extract_by_mask(grid.stack(spark, d, "lc_2011", "chg"), grid.study_mask(spark, d))
    return labelled(g.select("r", "c", col.forest_change("lc_2011", "chg").alias("v")), "NLCD")


@query("change_encode", sql("SELECT r, c, lc_2001 * 100 + lc_2021 AS v FROM stack"))
def change_encode(spark, d):
    return change_cells(grid.stack(spark, d), "lc_2001", "lc_2021")


DECODED = """rat AS (SELECT lc_2001 AS s, lc_2021 AS e, count(*) AS n FROM stack GROUP BY 1, 2),
decoded AS (SELECT s * 100 + e AS v, n, s AS start_class, a.label AS start_class_name, e AS end_class,
b.label AS end_class_name, CASE WHEN s = e THEN 'No change' ELSE a.label || ' to ' || b.label END AS change_type
FROM rat LEFT JOIN detailed a ON s = a.code LEFT JOIN detailed b ON e = b.code)"""


@query("change_decode", sql("SELECT * FROM decoded", DETAILED, DECODED))
def change_decode_query(spark, d):
    return change_decode(build_rat(change_cells(grid.stack(spark, d), "lc_2001", "lc_2021")))


@query(
    "label_class",
    sql(
        "SELECT r, c, lc_2016 AS v, label AS CoverClass FROM stack LEFT JOIN detailed ON lc_2016 = code",
        DETAILED,
    ),
)
def label_class(spark, d):
    return labelled(grid.layer(spark, d, "lc_2016"), "NLCD")


_RAT = "rat AS (SELECT lc_2001 AS v, count(*) AS n FROM stack GROUP BY 1)"


def _rat(spark, d):
    return build_rat(grid.layer(spark, d, "lc_2001"))


@query(
    "area_fields",
    sql("SELECT v, n, n * 0.09::DOUBLE AS Area_ha, n * 0.2223948429::DOUBLE AS Area_ac FROM rat", _RAT),
)
def area_fields(spark, d):
    return _rat(spark, d).withColumns({"Area_ha": col.area_ha("n"), "Area_ac": col.area_ac("n")})


@query("area_ha_900", sql("SELECT v, n, n * 900 / 10000 AS area_ha FROM rat", _RAT))
def area_ha_900(spark, d):
    return _rat(spark, d).withColumn("area_ha", col.area_ha_900("n"))


@query(
    "select_rename",
    sql(
        "SELECT v AS Code, label AS Class, n * 0.09::DOUBLE AS \"2001\" FROM rat LEFT JOIN detailed ON v = code",
        DETAILED,
        _RAT,
    ),
)
def select_rename(spark, d):
    table = labelled(_rat(spark, d), "NLCD").withColumns(
        {"Area_ha_2001": col.area_ha("n"), "Red": F.lit(0), "Green": F.lit(0), "Blue": F.lit(0), "Opacity": F.lit(1)}
    )
    kept = table.drop("n", "Red", "Green", "Blue", "Opacity")
    return kept.withColumnsRenamed({"v": "Code", "CoverClass": "Class", "Area_ha_2001": "2001"})


@query(
    "scale_to_int",
    sql(
        "SELECT r, c, CAST(floor(impsur / 3.0::DOUBLE * 100 + 0.5) AS INTEGER) AS impsur, "
        "CAST(floor((canopy % 10) / 10.0::DOUBLE * 10000 + 0.5) AS INTEGER) AS wet FROM stack"
    ),
)
def scale_to_int(spark, d):
    return grid.stack(spark, d, "impsur", "canopy").select(
        "r",
        "c",
        col.scale_to_int(F.col("impsur") / F.lit(3.0), "impsur").alias("impsur"),
        col.scale_to_int((F.col("canopy") % 10) / F.lit(10.0), "wet").alias("wet"),
    )


SUMMARY_RAT = f"""sums AS (SELECT CAST(CASE
WHEN lc_2001 IN {in_sql(codes.FOREST)} AND lc_2021 IN {in_sql(codes.FOREST)} THEN 1
WHEN lc_2001 IN {in_sql(codes.FOREST)} AND lc_2021 IN {in_sql(codes.DEVELOPED)} THEN 2
WHEN lc_2001 IN {in_sql(codes.FOREST)} THEN 3
WHEN lc_2001 IN {in_sql(codes.DEVELOPED)} AND lc_2021 IN {in_sql(codes.FOREST)} THEN 4
WHEN lc_2021 IN {in_sql(codes.FOREST)} THEN 5 ELSE 0 END AS INTEGER) AS v, count(*) AS n FROM stack GROUP BY 1)"""


def summary_rat(spark, d):
    change = change_cells(grid.stack(spark, d), "lc_2001", "lc_2021")
    return build_rat(change_summary_cells(change, codes.FOREST, codes.DEVELOPED))


@query(
    "table_view_where",
    sql("SELECT v, n, CASE WHEN v IN (1, 2, 3) THEN n * 900 / 10000 END AS area_ha FROM sums", SUMMARY_RAT),
)
def table_view_where(spark, d):
    out = summary_rat(spark, d)
    return out.withColumn("area_ha", F.when(F.col("v").isin(1, 2, 3), col.area_ha_900("n")))


_PERIOD_RAT = "periods AS (" + " UNION ALL ".join(
    f"SELECT '{a}-{b}' AS period, lc_{a} AS s, lc_{b} AS e, count(*) AS n FROM stack GROUP BY 2, 3"
    for a, b in codes.PERIODS
) + ")"


@query(
    "loss_gain_filter",
    sql(
        "SELECT period, s * 100 + e AS v, n, s AS start_class, e AS end_class FROM periods WHERE period <> '2011-2021' "
        f"AND ((s IN {in_sql(codes.FOREST)} AND e NOT IN {in_sql(codes.FOREST)}) "
        f"OR (e IN {in_sql(codes.FOREST)} AND s NOT IN {in_sql(codes.FOREST)}))",
        _PERIOD_RAT,
    ),
)
def loss_gain_filter_query(spark, d):
    rat = change_counts(grid.stack(spark, d), codes.PERIODS)
    rat = rat.withColumns({"start_class": col.start_class("v"), "end_class": col.end_class("v")})
    return loss_gain_filter(rat, codes.FOREST, ("2011-2021",))


@query(
    "successional_merge",
    sql(
        "SELECT v, count(*) AS n FROM (SELECT CASE WHEN lc_2011 IN (52, 71) AND chg = 11 THEN 61 "
        "ELSE lc_2011 END AS v FROM stack) GROUP BY v"
    ),
)
def successional_merge(spark, d):
    g = grid.stack(spark, d, "lc_2011", "chg")
    return build_rat(g.select(col.merge_successional(col.forest_change("lc_2011", "chg")).alias("v")))


@query(
    "general_decade",
    sql(
        f"SELECT v, n, CASE WHEN v IN {in_sql(codes.FOREST)} THEN '99' "
        "ELSE CAST((v // 10) * 10 AS VARCHAR) END AS gen FROM rat",
        _RAT,
    ),
)
def general_decade(spark, d):
    return _rat(spark, d).withColumn("gen", col.decade("v", codes.FOREST))


_TO_FROM = f"""tagged AS (SELECT v, n, CAST(CASE
WHEN start_class IN {in_sql(codes.FOREST)} AND end_class IN {in_sql(codes.FOREST)} THEN 1
WHEN start_class IN {in_sql(codes.FOREST)} THEN CAST('41' || end_class AS INTEGER)
WHEN end_class IN {in_sql(codes.FOREST)} THEN CAST(start_class || '41' AS INTEGER) ELSE 0 END AS INTEGER) AS code,
CASE WHEN start_class IN {in_sql(codes.FOREST)} AND end_class IN {in_sql(codes.FOREST)} THEN 'Forest both time periods'
WHEN start_class IN {in_sql(codes.FOREST)} THEN 'Forest to ' || end_class_name
WHEN end_class IN {in_sql(codes.FOREST)} THEN start_class_name || ' to Forest'
ELSE 'Not Forest either time period' END AS kind FROM decoded),
to_from AS (SELECT code AS v, CAST(sum(n) AS BIGINT) AS n, min(kind) AS change_type,
CAST(sum(n) AS BIGINT) * 900 / 10000 AS area_ha FROM tagged GROUP BY code)"""
TO_FROM = (DETAILED, DECODED, _TO_FROM)


def to_from(spark, d):
    rat = build_rat(change_cells(grid.stack(spark, d), "lc_2001", "lc_2021"))
    return change_to_from(rat, codes.FOREST, "Forest")


@query("round_tens", sql("SELECT v, n, CAST(round_even(v, -1) AS INTEGER) AS general FROM to_from", *TO_FROM))
def round_tens(spark, d):
    return to_from(spark, d).select("v", "n", F.bround("v", -1).cast("int").alias("general"))


@query(
    "drop_codes_filter",
    sql(
        "SELECT v, n, change_type, area_ha, CASE WHEN starts_with(change_type, 'Forest to') THEN 'Forest loss' "
        "ELSE 'Forest gain' END AS kind FROM to_from WHERE v NOT IN (0, 1)",
        *TO_FROM,
    ),
)
def drop_codes_filter(spark, d):
    out = to_from(spark, d).filter(~F.col("v").isin(0, 1)).drop("perc_area")
    lost = F.col("change_type").startswith("Forest to")
    return out.withColumn("kind", F.when(lost, "Forest loss").otherwise("Forest gain"))


@query("extent_clip", sql("SELECT r, c, lc_2001 AS v FROM stack WHERE r >= 2 AND c BETWEEN 20 AND 80"))
def extent_clip(spark, d):
    """A stored layer; the rectangle's filter reaches the scan."""
    kept = stored(spark, d, "lc_2001").filter(F.col("layer") == "lc_2001")
    return overlay.extent_clip(kept.select("r", "c", "v"), r0=2, c0=20, c1=80)


@query("extract_by_mask", sql("SELECT r, c, lc_2001 AS v FROM stack SEMI JOIN mask USING (r, c)"))
def extract_by_mask(spark, d):
    return overlay.extract_by_mask(grid.layer(spark, d, "lc_2001"), grid.study_mask(spark, d))


@query("extract_by_mask_shuffled", sql("SELECT r, c, lc_2001 AS v FROM stack SEMI JOIN mask USING (r, c)"))
def extract_by_mask_shuffled(spark, d):
    """The way a mask of too many runs to broadcast takes."""
    return overlay.extract_by_mask(grid.layer(spark, d, "lc_2001"), grid.study_mask(spark, d), limit=0)


@query(
    "calculate_field",
    sql("SELECT v, n, 100 * n / (SELECT CAST(sum(n) AS BIGINT) FROM rat) AS percent FROM rat", _RAT),
)
def calculate_field_query(spark, d):
    table = _rat(spark, d).withColumn("total", F.sum("n").over(W.partitionBy(F.lit(0))))
    return calculate(table, "percent", "100 * n / total").drop("total")
