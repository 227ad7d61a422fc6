"""Two-date change queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.operators.tabulate import build_rat
from cellweave.plans import barren, change, landscape
from cellweave.registry.base import DETAILED, in_sql, query, remap_sql, sql
from cellweave.registry.neighbourhoods import CHAIN, CHAIN_TILE
from cellweave.registry.projections import DECODED, SUMMARY_RAT, TO_FROM, to_from
from cellweave.registry.scans import EDGES_SQL, INSIDE_SQL, POINTS_SQL, study_edges
from cellweave.registry.tables import GAINLOSS, GEN_LONG, PCT, STATS, gen_summary
from cellweave.session import shared_path
from cellweave.sources import events_grid as grid
from cellweave.sources.cells import write_table

_MASKED = DECODED.replace("FROM stack GROUP BY", "FROM stack SEMI JOIN mask USING (r, c) GROUP BY")


@query(
    "change_rast",
    sql(
        "SELECT v, n, start_class, start_class_name, end_class, end_class_name, change_type, "
        "n * 900 / 10000 AS area_ha, n / sum(n) OVER () * 100 AS perc_total FROM decoded",
        DETAILED,
        _MASKED,
    ),
)
def change_rast(spark, d):
    st = grid.stack(spark, d, "lc_2001", "lc_2021")
    return change.change_rast(st, "lc_2001", "lc_2021", grid.study_mask(spark, d))


@query(
    "change_rast_unmasked",
    sql(
        "SELECT v, n, start_class, start_class_name, end_class, end_class_name, change_type, "
        "n * 900 / 10000 AS area_ha, n / sum(n) OVER () * 100 AS perc_total FROM decoded",
        DETAILED,
        DECODED,
    ),
)
def change_rast_unmasked(spark, d):
    return change.change_rast(grid.stack(spark, d, "lc_2001", "lc_2021"), "lc_2001", "lc_2021")


def _summary_sql(backwards: bool) -> str:
    four = "Developed to Forest" if backwards else "non-Forest class to Forest"
    folded = "v" if backwards else "CASE WHEN v = 5 THEN 4 ELSE v END"
    return sql(
        "SELECT v, n, ['not Forest in either time period', 'Forest in both time periods', 'Forest to Developed', "
        f"'Forest to non-Developed class', '{four}', 'non-Developed class to Forest'][v + 1] AS class, "
        "n * 900 / 10000 AS area_ha, CASE WHEN v IN (1, 2, 3) THEN n / sum(n) FILTER (WHERE v IN (1, 2, 3)) OVER () * 100 END "
        f"AS perc_of_t1_area FROM (SELECT {folded} AS v, CAST(sum(n) AS BIGINT) AS n FROM sums GROUP BY 1)",
        SUMMARY_RAT,
    )


def _summary(backwards: bool):
    def run(spark, d):
        st = grid.stack(spark, d, "lc_2001", "lc_2021")
        rat = build_rat(change.change_cells(st, "lc_2001", "lc_2021"))
        return change.forest_developed(rat, backwards)

    return run


query("change_summary_fwd", _summary_sql(False))(_summary(False))
query("change_summary_bwd", _summary_sql(True))(_summary(True))


@query(
    "change_summary_general",
    sql(
        "SELECT v, n, ['not Natural in either time period', 'Natural in both time periods', 'Natural to Developed', "
        "'Natural to non-Developed class', 'Developed to Natural', 'non-Developed class to Natural'][v + 1] AS class, "
        "n * 900 / 10000 AS area_ha, CASE WHEN v IN (1, 2, 3) THEN n / sum(n) FILTER (WHERE v IN (1, 2, 3)) OVER () * 100 END "
        "AS perc_of_t1_area FROM (SELECT CAST(CASE WHEN s = 4 AND e = 4 THEN 1 WHEN s = 4 AND e = 2 THEN 2 WHEN s = 4 THEN 3 "
        "WHEN s = 2 AND e = 4 THEN 4 WHEN e = 4 THEN 5 ELSE 0 END AS INTEGER) AS v, count(*) AS n FROM (SELECT "
        f"{remap_sql('lc_2001', codes.TO_GENERAL)} AS s, {remap_sql('lc_2021', codes.TO_GENERAL)} AS e FROM stack) "
        "WHERE s IS NOT NULL AND e IS NOT NULL GROUP BY 1)"
    ),
)
def change_summary_general(spark, d):
    """Natural against developed cells of the general classes."""
    st = landscape.general_stack(grid.stack(spark, d, "lc_2001", "lc_2021"), ["lc_2001", "lc_2021"])
    rat = build_rat(change.change_cells(st, "lc_2001", "lc_2021"))
    return change.change_summary(rat, [4], "Natural", [2], "Developed")


@query(
    "change_summary_cells",
    sql(
        "SELECT r, c, CAST(CASE "
        f"WHEN lc_2001 IN {in_sql(codes.FOREST)} AND lc_2021 IN {in_sql(codes.FOREST)} THEN 1 "
        f"WHEN lc_2001 IN {in_sql(codes.FOREST)} AND lc_2021 IN {in_sql(codes.DEVELOPED)} THEN 2 "
        f"WHEN lc_2001 IN {in_sql(codes.FOREST)} THEN 3 "
        f"WHEN lc_2001 IN {in_sql(codes.DEVELOPED)} AND lc_2021 IN {in_sql(codes.FOREST)} THEN 4 "
        f"WHEN lc_2021 IN {in_sql(codes.FOREST)} THEN 5 ELSE 0 END AS INTEGER) AS v FROM stack"
    ),
)
def change_summary_cells(spark, d):
    cells = change.change_cells(grid.stack(spark, d), "lc_2001", "lc_2021")
    return change.change_summary_cells(cells, codes.FOREST, codes.DEVELOPED, backwards=True)


@query(
    "change_to_from",
    sql(
        "SELECT v, n, change_type, area_ha, n / sum(n) OVER () * 100 AS perc_area FROM to_from", *TO_FROM
    ),
)
def change_to_from(spark, d):
    return to_from(spark, d)


@query(
    "change_run",
    sql(
        "SELECT period, v, n, n * 900 / 10000 AS area_ha FROM ("
        + " UNION ALL ".join(
            f"SELECT '{a}-{b}' AS period, lc_{a} * 100 + lc_{b} AS v, count(*) AS n FROM stack GROUP BY 2"
            for a, b in codes.PERIODS
        )
        + ")"
    ),
)
def change_run(spark, d):
    """Change codes of every period from one scan."""
    rat = change.change_counts(grid.stack(spark, d, "lc_2001", "lc_2011", "lc_2021"), codes.PERIODS)
    return rat.withColumn("area_ha", change.area_ha_900("n"))


@query(
    "change_run_resume",
    sql(
        "SELECT period, v, n FROM ("
        + " UNION ALL ".join(
            f"SELECT '{a}-{b}' AS period, lc_{a} * 100 + lc_{b} AS v, count(*) AS n FROM stack GROUP BY 2"
            for a, b in codes.PERIODS
        )
        + ")"
    ),
)
def change_run_resume(spark, d):
    """A run after one that was stopped: the period stored already is not counted again."""
    st = grid.stack(spark, d, "lc_2001", "lc_2011", "lc_2021")
    path = shared_path(spark, "periods")
    write_table(change.change_counts(st, codes.PERIODS[:1]), path)
    return change.change_counts(st, codes.PERIODS, stored=spark.read.parquet(path))


_CLIPPED = ", ".join(
    [
        "clipped AS (SELECT * FROM stack SEMI JOIN inside USING (r, c))",
        "counts AS ("
        + " UNION ALL ".join(
            f"SELECT '{a}-{b}' AS period, lc_{a} AS s, lc_{b} AS e, count(*) AS n FROM clipped GROUP BY 2, 3"
            for a, b in codes.PERIODS
        )
        + ")",
    ]
)


@query(
    "change_run_masked",
    sql(
        "SELECT period, s * 100 + e AS v, n, s AS start_class, a.label AS start_class_name, e AS end_class, "
        "b.label AS end_class_name, CASE WHEN s = e THEN 'No change' ELSE a.label || ' to ' || b.label END AS change_type, "
        "n * 900 / 10000 AS area_ha, n / sum(n) OVER (PARTITION BY period) * 100 AS perc_total "
        "FROM counts LEFT JOIN detailed a ON s = a.code LEFT JOIN detailed b ON e = b.code",
        DETAILED, POINTS_SQL, EDGES_SQL, INSIDE_SQL, _CLIPPED,
    ),
)
def change_run_masked(spark, d):
    """All periods inside the study polygon, with classes, areas and shares, from one scan."""
    st = grid.stack(spark, d, "lc_2001", "lc_2011", "lc_2021")
    return change.change_run(st, codes.PERIODS, study_edges(spark, d))


@query(
    "change_summary_run",
    sql(
        "SELECT period, v, n, ['not Forest in either time period', 'Forest in both time periods', 'Forest to Developed', "
        "'Forest to non-Developed class', 'non-Forest class to Forest'][v + 1] AS class, n * 900 / 10000 AS area_ha, "
        "CASE WHEN v IN (1, 2, 3) THEN n / sum(n) FILTER (WHERE v IN (1, 2, 3)) OVER (PARTITION BY period) * 100 END "
        "AS perc_of_t1_area FROM (SELECT period, CAST(CASE "
        f"WHEN s IN {in_sql(codes.FOREST)} AND e IN {in_sql(codes.FOREST)} THEN 1 "
        f"WHEN s IN {in_sql(codes.FOREST)} AND e IN {in_sql(codes.DEVELOPED)} THEN 2 "
        f"WHEN s IN {in_sql(codes.FOREST)} THEN 3 WHEN e IN {in_sql(codes.FOREST)} THEN 4 ELSE 0 END AS INTEGER) AS v, "
        "CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY 1, 2)",
        POINTS_SQL, EDGES_SQL, INSIDE_SQL, _CLIPPED,
    ),
)
def change_summary_run(spark, d):
    """The forward summary of all periods inside the study polygon."""
    st = grid.stack(spark, d, "lc_2001", "lc_2011", "lc_2021")
    return change.forest_developed(change.change_run(st, codes.PERIODS, study_edges(spark, d)), False, ("period",))


_F = in_sql(codes.FOREST)


@query(
    "change_to_from_cells",
    sql(
        f"SELECT r, c, CAST(CASE WHEN lc_2001 IN {_F} AND lc_2021 IN {_F} THEN 1 "
        f"WHEN lc_2001 IN {_F} THEN CAST({codes.FOREST[0]} || CAST(lc_2021 AS VARCHAR) AS INTEGER) "
        f"WHEN lc_2021 IN {_F} THEN CAST(CAST(lc_2001 AS VARCHAR) || {codes.FOREST[0]} AS INTEGER) "
        "ELSE 0 END AS INTEGER) AS v FROM stack"
    ),
)
def change_to_from_cells(spark, d):
    cells = change.change_cells(grid.stack(spark, d), "lc_2001", "lc_2021")
    return change.change_to_from_cells(cells, codes.FOREST)


@query(
    "general_change_trend",
    sql(
        "SELECT p.v, p.CoverClass, p.year, p.Area_ha, p.pct_change, p.label, s.area_change AS full_change, "
        "s.pct_change AS full_pct, s.label AS full_label FROM pct p LEFT JOIN stats s "
        "ON p.CoverClass IS NOT DISTINCT FROM s.CoverClass",
        *GEN_LONG,
        PCT,
        STATS,
    ),
)
def general_change_trend(spark, d):
    series, stats = landscape.general_change_trend(gen_summary(spark, d))
    stats = stats.select(
        F.col("CoverClass").alias("_class"),
        F.col("area_change").alias("full_change"),
        F.col("pct_change").alias("full_pct"),
        F.col("label").alias("full_label"),
    )
    # A class without a name, as an unlisted code, keeps its rows.
    return series.drop("name").join(stats, F.col("CoverClass").eqNullSafe(F.col("_class")), "left").drop("_class")


@query(
    "net_change_run",
    sql(
        "SELECT * FROM net",
        *CHAIN,
        "periods AS ("
        + " UNION ALL ".join(
            f"SELECT '{a}-{b}' AS period, x.ref AS s, y.ref AS e, count(*) AS n FROM y{a}_out x "
            f"JOIN y{b}_out y USING (r, c) WHERE x.ref IS NOT NULL AND y.ref IS NOT NULL GROUP BY 2, 3"
            for a, b in codes.PERIODS
        )
        + ")",
        GAINLOSS[1],
    ),
)
def net_change_run(spark, d):
    """From the raw layers to net forest change: barren cells split, periods compared, moves netted."""
    split = barren.barren_chain(grid.stack(spark, d), codes.YEARS, tile=CHAIN_TILE)
    counts = change.change_counts(split, codes.PERIODS, "b_{}")
    return change.net_change(counts, codes.FOREST, "Forest", "2001-2021")
