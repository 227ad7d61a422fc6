"""Joins, aggregates, windows, sorts, set operations, scalar functions, reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.functions import columns as col
from cellweave.model import GridSpec
from cellweave.operators import overlay, regions, tabulate
from cellweave.operators.tabulate import build_rat, share
from cellweave.plans import change, landscape
from cellweave.registry.base import DETAILED, GENERAL, in_sql, query, remap_sql, sql
from cellweave.registry.projections import DECODED, SUMMARY_RAT, TO_FROM, summary_rat, to_from
from cellweave.registry.scans import ORDER_LAYERS, order_layers
from cellweave.session import shared_path, shuffle_partitions
from cellweave.sources import coded
from cellweave.sources import events_grid as grid
from cellweave.sources.events_grid import LAYERS

YEARS = codes.YEARS

# ---- joins


@query(
    "overlay_join",
    sql(
        "SELECT a.r, a.c, a.lc_2001 * 100 + b.lc_2021 AS code, CASE WHEN a.impsur <> 127 AND b.canopy <> 255 "
        "THEN a.impsur + b.canopy END AS cover FROM stack a JOIN stack b USING (r, c)"
    ),
)
def overlay_join(spark, d):
    """Layers stored as coded rows in equal buckets meet run by run, without a shuffle."""

    def layer(name, sentinel=None):
        g = grid.layer(spark, d, name)
        g = g if sentinel is None else g.withColumn("v", col.set_null("v", sentinel))
        path = shared_path(spark, "coded")
        coded.write_coded(g, table := path.rpartition("/")[2].replace("-", "_"), path, shuffle_partitions(spark))
        return spark.table(table)

    g = coded.overlay_coded(
        {
            "t1": layer("lc_2001"),
            "t2": layer("lc_2021"),
            "imp": layer("impsur", codes.IMPERVIOUS_NODATA),
            "can": layer("canopy", codes.CANOPY_NODATA),
        }
    )
    return g.select("r", "c", col.change_code("t1", "t2").alias("code"), (F.col("imp") + F.col("can")).alias("cover"))


@query(
    "overlay_counts",
    sql("SELECT lc_2001, lc_2021, count(*) AS n FROM stack GROUP BY lc_2001, lc_2021"),
)
def overlay_counts(spark, d):
    """Cells of each pair of classes, from the lengths of runs: no cell is spelled out."""
    tables = {}
    for name in ("lc_2001", "lc_2021"):
        path = shared_path(spark, "coded")
        table = path.rpartition("/")[2].replace("-", "_")
        coded.write_coded(grid.layer(spark, d, name), table, path, shuffle_partitions(spark))
        tables[name] = spark.table(table)
    runs = coded.overlay_runs(tables)
    return runs.groupBy(*tables).agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))


@query("overlay_stack", sql("SELECT r, c, lc_2001, lc_2011, lc_2021 FROM stack"))
def overlay_stack(spark, d):
    names = ["lc_2001", "lc_2011", "lc_2021"]
    return overlay.stack_layers(grid.cells(spark, d), names)


def _rats(*layers):
    return ", ".join(
        f"{x}_rat AS (SELECT {x} AS v, count(*) AS n FROM stack GROUP BY 1)" for x in layers
    )


@query(
    "join_field",
    sql(
        "SELECT a.v, a.n, b.n AS n_2021, b.n * 0.09::DOUBLE AS Area_ha_2021 FROM lc_2001_rat a "
        "LEFT JOIN lc_2021_rat b USING (v)",
        _rats("lc_2001", "lc_2021"),
    ),
)
def join_field(spark, d):
    left = build_rat(grid.layer(spark, d, "lc_2001"))
    right = build_rat(grid.layer(spark, d, "lc_2021")).withColumnRenamed("n", "n_2021")
    right = right.withColumn("Area_ha_2021", col.area_ha("n_2021"))
    return tabulate.join_field(left, right, "v", ["n_2021", "Area_ha_2021"])


@query("join_field_first", sql("SELECT v, n, change_type FROM to_from", *TO_FROM))
def join_field_first(spark, d):
    rat = build_rat(change.change_cells(grid.stack(spark, d), "lc_2001", "lc_2021"))
    table = change.to_from_table(rat, codes.FOREST, "Forest")
    counts = table.groupBy(F.col("reclass").alias("v")).agg(F.sum("n").alias("n"))
    return tabulate.join_field_first(counts, table, "v", "reclass", "change_type")


_COMBOS = (
    "combos AS (SELECT a.v * 100 + b.v AS code, a.v AS start_class, b.v AS end_class "
    "FROM (SELECT DISTINCT lc_2001 AS v FROM stack) a, (SELECT DISTINCT lc_2021 AS v FROM stack) b)"
)


@query("class_combos", sql("SELECT * FROM combos", _COMBOS))
def class_combos(spark, d):
    return tabulate.class_combos(grid.stack(spark, d, "lc_2001", "lc_2021"), "lc_2001", "lc_2021")


@query(
    "lookup_first",
    sql(
        "SELECT code, n, start_class, end_class FROM (SELECT lc_2001 * 100 + lc_2021 AS code, count(*) AS n "
        "FROM stack GROUP BY 1) JOIN combos USING (code)",
        _COMBOS,
    ),
)
def lookup_first(spark, d):
    st = grid.stack(spark, d, "lc_2001", "lc_2021")
    rat = build_rat(change.change_cells(st, "lc_2001", "lc_2021")).withColumnRenamed("v", "code")
    return tabulate.lookup_first(rat, tabulate.occurring_combos(st, "lc_2001", "lc_2021"))


# ---- aggregates


@query(
    "build_rat",
    sql(
        f"SELECT layer, g AS v, count(*) AS n FROM (SELECT layer, {remap_sql('v', codes.TO_GENERAL)} AS g FROM cells) "
        "WHERE g IS NOT NULL GROUP BY 1, 2"
    ),
)
def build_rat_query(spark, d):
    g = grid.cells(spark, d).withColumn("v", col.reclass("v", codes.TO_GENERAL))
    return build_rat(g, "layer")


@query(
    "layer_stats",
    sql(
        "SELECT layer, min(v) AS min_v, max(v) AS max_v, round(avg(v), 6) AS mean_v, "
        "round(stddev_pop(v), 6) AS std_v FROM cells GROUP BY layer"
    ),
)
def layer_stats(spark, d):
    out = tabulate.layer_stats(grid.cells(spark, d))
    return out.withColumns({"mean_v": F.round("mean_v", 6), "std_v": F.round("std_v", 6)})


@query("total_cells", sql("SELECT count(*) AS total FROM stack WHERE lc_2001 <> 0"))
def total_cells(spark, d):
    g = grid.layer(spark, d, "lc_2001").withColumn("v", col.set_null("v", 0))
    return tabulate.total_cells(build_rat(g))


@query(
    "conditional_total",
    sql("SELECT CAST(sum(n) FILTER (WHERE v IN (1, 2, 3)) AS BIGINT) AS total FROM sums", SUMMARY_RAT),
)
def conditional_total(spark, d):
    return tabulate.conditional_total(summary_rat(spark, d), [1, 2, 3])


@query(
    "change_matrix",
    sql(
        "SELECT start_class, end_class, n, n * 900 / 10000 AS area_ha, n / sum(n) OVER () * 100 AS perc_total "
        "FROM decoded",
        DETAILED,
        DECODED,
    ),
)
def change_matrix(spark, d):
    out = change.change_rast(grid.stack(spark, d), "lc_2001", "lc_2021")
    return out.select("start_class", "end_class", "n", "area_ha", "perc_total")


def yearly_sql(rat: str, years=YEARS, label: str = "") -> str:
    """The yearly table over a ``year, v, n`` relation; the first year has the rows and the total."""
    first, last = years[0], years[-1]
    cols = ", ".join(
        f"100 * y{y}.n / total AS Percent_{y}, y{y}.n * 0.09::DOUBLE AS Area_ha_{y}, "
        f"y{y}.n * 0.2223948429::DOUBLE AS Area_ac_{y}"
        for y in years
    )
    joins = " ".join(
        f"LEFT JOIN (SELECT v, n FROM {rat} WHERE year = {y}) y{y} ON y{first}.v = y{y}.v" for y in years[1:]
    )
    ha, start = f"(y{last}.n * 0.09::DOUBLE - y{first}.n * 0.09::DOUBLE)", f"(y{first}.n * 0.09::DOUBLE)"
    ac = f"(y{last}.n * 0.2223948429::DOUBLE - y{first}.n * 0.2223948429::DOUBLE)"
    names = f", {label}.label AS CoverClass" if label else ""
    named = f"LEFT JOIN {label} ON y{first}.v = {label}.code" if label else ""
    return (
        f"SELECT y{first}.v{names}, {cols}, {ha} AS Change_ha, {ac} AS Change_ac, 100 * {ha} / {start} AS Change_perc "
        f"FROM (SELECT v, n FROM {rat} WHERE year = {first}) y{first} "
        f"CROSS JOIN (SELECT CAST(sum(n) AS BIGINT) AS total FROM {rat} WHERE year = {first}) {joins} {named}"
    )


_YEARLY = "yearly AS (SELECT year, v, count(*) AS n FROM cells GROUP BY 1, 2)"
_GENERAL_YEARLY = (
    f"gen_cells AS (SELECT year, {remap_sql('v', codes.TO_GENERAL)} AS v FROM cells), "
    "yearly AS (SELECT year, v, count(*) AS n FROM gen_cells WHERE v IS NOT NULL GROUP BY 1, 2)"
)


@query("tab_lc_types", sql(yearly_sql("yearly"), _YEARLY))
def tab_lc_types(spark, d):
    return tabulate.tab_lc_types(landscape.yearly_rat(grid.stack(spark, d), LAYERS), YEARS)


@query(
    "tab_lc_types_clipped",
    sql(
        yearly_sql("yearly", label="detailed"),
        DETAILED,
        "yearly AS (SELECT year, v, count(*) AS n FROM cells SEMI JOIN mask USING (r, c) GROUP BY 1, 2)",
    ),
)
def tab_lc_types_clipped(spark, d):
    st = overlay.extract_by_mask(grid.stack(spark, d, *LAYERS), grid.study_mask(spark, d))
    return tabulate.tab_lc_types(landscape.yearly_rat(st, LAYERS), YEARS, "NLCD")


_F = in_sql(codes.FOREST)
_GAINLOSS = (
    f"""moves AS (SELECT period, CASE WHEN s IN {_F} THEN '99' ELSE CAST((s // 10) * 10 AS VARCHAR) END AS gen_start,
CASE WHEN e IN {_F} THEN '99' ELSE CAST((e // 10) * 10 AS VARCHAR) END AS gen_end, n FROM
(SELECT period, CASE WHEN s IN (56, 75) THEN 61 ELSE s END AS s, CASE WHEN e IN (56, 75) THEN 61 ELSE e END AS e, n
FROM periods) WHERE (s IN {_F}) <> (e IN {_F})),
areas AS (SELECT gen_start, gen_end, period AS chg_years, CAST(sum(n) AS BIGINT) AS n,
CAST(sum(n) AS BIGINT) * 900 / 10000 AS hectares FROM moves GROUP BY 1, 2, 3),
decades AS (SELECT unnest(['20','80','30','40','50','60','70','90','10','99']) AS code,
unnest(['Developed','Agriculture','Barren','Forest','Shrub/Scrub','Successional','Herbaceous','Wetlands','Water','Forest']) AS label,
unnest([1,2,3,4,5,6,7,8,9,10]) AS ord),
lossgain AS (SELECT gen_start, gen_end, chg_years, n, hectares, CASE WHEN gen_start = '99' THEN 'Loss' ELSE 'Gain' END AS to_from,
label AS chg_class, ord FROM areas LEFT JOIN decades ON code = CASE WHEN gen_start = '99' THEN gen_end ELSE gen_start END),
net AS (SELECT chg_years, chg_class, CAST(sum(CASE WHEN to_from = 'Loss' THEN -n ELSE n END) AS BIGINT) * 900 / 10000 AS ha,
CASE WHEN chg_years = '2001-2021' THEN 'Full period' ELSE ' Intermediate periods' END AS grp FROM lossgain GROUP BY 1, 2)"""
)


def _forest_stack_sql():
    cols = ", ".join(
        f"CASE WHEN lc_{y} IN (52, 71) AND chg = 11 THEN lc_{y} + 4 ELSE lc_{y} END AS lc_{y}"
        for y in (2001, 2011, 2021)
    )
    return (
        "periods AS (WITH marked AS (SELECT " + cols + " FROM stack) "
        + " UNION ALL ".join(
            f"SELECT '{a}-{b}' AS period, lc_{a} AS s, lc_{b} AS e, count(*) AS n FROM marked GROUP BY 2, 3"
            for a, b in codes.PERIODS
        )
        + ")"
    )


def period_rat(spark, d):
    """Change codes of the three periods; disturbed shrub and herbaceous cells carry codes 56 and 75."""
    st = grid.stack(spark, d, "lc_2001", "lc_2011", "lc_2021", "chg")
    marked = {f"lc_{y}": col.forest_change(f"lc_{y}", "chg") for y in (2001, 2011, 2021)}
    return change.change_counts(st.withColumns(marked), codes.PERIODS)


GAINLOSS = (_forest_stack_sql(), _GAINLOSS)


@query("period_class_area", sql("SELECT gen_start, gen_end, chg_years, n, hectares FROM areas", *GAINLOSS))
def period_class_area(spark, d):
    return change.period_class_area(period_rat(spark, d), codes.FOREST)


@query("net_change", sql("SELECT chg_years, chg_class, ha FROM net", *GAINLOSS))
def net_change(spark, d):
    return change.net_change(period_rat(spark, d), codes.FOREST, "Forest", "2001-2021").drop("grp")


@query("period_group", sql("SELECT DISTINCT chg_years, grp FROM net", *GAINLOSS))
def period_group(spark, d):
    out = change.net_change(period_rat(spark, d), codes.FOREST, "Forest", "2001-2021")
    return out.select("chg_years", "grp").distinct()


@query("forest_loss_gain", sql("SELECT * FROM lossgain", *GAINLOSS))
def forest_loss_gain(spark, d):
    return change.loss_gain(period_rat(spark, d), codes.FOREST, "Forest")


@query("forest_net_change", sql("SELECT * FROM net", *GAINLOSS))
def forest_net_change(spark, d):
    return change.net_change(period_rat(spark, d), codes.FOREST, "Forest", "2001-2021")


@query(
    "recode_factor",
    sql(
        "SELECT code, label, ord, n FROM (SELECT CASE WHEN v IN (41, 42, 43, 52, 90) THEN '99' "
        "ELSE CAST((v // 10) * 10 AS VARCHAR) END AS code, CAST(sum(n) AS BIGINT) AS n FROM "
        "(SELECT lc_2001 AS v, count(*) AS n FROM stack GROUP BY 1) GROUP BY 1) LEFT JOIN decades USING (code)",
        *GAINLOSS,
    ),
)
def recode_factor(spark, d):
    rat = build_rat(grid.layer(spark, d, "lc_2001"))
    out = rat.groupBy(col.decade("v", codes.FOREST).alias("code")).agg(F.sum("n").alias("n"))
    return out.withColumns(
        {"label": col.decade_label("code", "Forest"), "ord": col.decade_order("code")}
    )


# Yearly table of the general classes in the long form.
_LONG = (
    "long AS (SELECT y.v, g.label AS CoverClass, 'Area_ha_' || year AS name, n * 0.09::DOUBLE AS Area_ha, year "
    "FROM yearly y LEFT JOIN general g ON y.v = g.code WHERE v IN (SELECT v FROM yearly WHERE year = 2001))"
)
# Classes lacking in a later year keep a row without an area.
_LONG_FULL = (
    "long AS (SELECT k.v, g.label AS CoverClass, 'Area_ha_' || k.year AS name, n * 0.09::DOUBLE AS Area_ha, k.year "
    "FROM (SELECT a.v, b.year FROM (SELECT v FROM yearly WHERE year = 2001) a, (SELECT DISTINCT year FROM yearly) b) k "
    "LEFT JOIN yearly y ON k.v = y.v AND k.year = y.year LEFT JOIN detailed g ON k.v = g.code)"
)
PCT = """pct AS (SELECT *, CASE WHEN pct_change > 0 THEN '+' || t || '%' WHEN pct_change = 0 THEN '0%'
WHEN pct_change < 0 THEN t || '%' END AS label FROM (SELECT *, regexp_replace(printf('%.2f', pct_change), '\\.?0+$', '') AS t
FROM (SELECT *, round((Area_ha - prev) / nullif(prev, 0) * 100, 2) AS pct_change FROM
(SELECT *, lag(Area_ha) OVER (PARTITION BY v ORDER BY year) AS prev FROM long))))"""
STATS = """stats AS (SELECT *, CASE WHEN pct_change > 0 THEN '+' || t || '%' WHEN pct_change = 0 THEN '0%'
WHEN pct_change < 0 THEN t || '%' END AS label FROM (SELECT *, regexp_replace(printf('%.2f', pct_change), '\\.?0+$', '') AS t
FROM (SELECT *, round(area_change / nullif(first_ha, 0) * 100, 2) AS pct_change FROM
(SELECT CoverClass, CAST(median(year) AS DOUBLE) AS x, median(Area_ha) AS y,
arg_max(Area_ha, year) - arg_min(Area_ha, year) AS area_change, arg_min(Area_ha, year) AS first_ha
FROM long GROUP BY CoverClass))))"""
GEN_LONG = (GENERAL, _GENERAL_YEARLY, _LONG)


def gen_summary(spark, d):
    return landscape.general_summary(grid.stack(spark, d, *LAYERS), YEARS)


def gen_long(spark, d):
    return tabulate.unpivot_area(gen_summary(spark, d))


@query("class_period_stats", sql("SELECT CoverClass, x, y, area_change, pct_change, label FROM stats", *GEN_LONG, STATS))
def class_period_stats(spark, d):
    return tabulate.class_period_stats(gen_long(spark, d))


@query(
    "freq_table",
    sql("SELECT start_class, start_class_name, count(*) AS freq FROM decoded GROUP BY 1, 2", DETAILED, DECODED),
)
def freq_table(spark, d):
    rat = change.change_decode(build_rat(change.change_cells(grid.stack(spark, d), "lc_2001", "lc_2021")))
    return tabulate.freq_table(rat, "start_class", "start_class_name")


@query("count_features", sql("SELECT count(DISTINCT feat_id) AS n FROM region"))
def count_features(spark, d):
    return regions.count_features(grid.forest_regions(spark, d))


@query(
    "count_selected",
    sql("SELECT count(DISTINCT feat_id) FILTER (WHERE c < 40) AS n_selected, count(DISTINCT feat_id) AS n_all FROM region"),
)
def count_selected(spark, d):
    return regions.count_selected(grid.forest_regions(spark, d), F.col("c") < 40)


@query("unique_values", sql("SELECT DISTINCT lc_2001 AS v FROM stack ORDER BY 1"))
def unique_values(spark, d):
    return tabulate.unique_values(grid.layer(spark, d, "lc_2001"), "v")


@query("tab_to_dict", sql("SELECT v AS key, arg_max(n, year) AS value FROM yearly GROUP BY v", _YEARLY))
def tab_to_dict(spark, d):
    rat = landscape.yearly_rat(grid.stack(spark, d), LAYERS)
    return tabulate.tab_to_dict(rat, "v", "n", "year")


def _plain_sql(x):
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(24,6)) AS VARCHAR), '(\\.\\d+?)0+$', '\\1')"


@query(
    "extent_rect",
    sql(
        "SELECT " + " || ' ' || ".join(
            _plain_sql(x)
            for x in ("min(c) * 30.0", "min(r) * 30.0", "(max(c) + 1) * 30.0", "(max(r) + 1) * 30.0")
        ) + " AS rect FROM region"
    ),
)
def extent_rect(spark, d):
    return overlay.extent_rect(grid.forest_regions(spark, d), GridSpec())


# ---- windows and sorts


@query("lag_pct_change", sql("SELECT v, CoverClass, name, Area_ha, year, pct_change, label FROM pct", *GEN_LONG, PCT))
def lag_pct_change(spark, d):
    return tabulate.lag_pct_change(gen_long(spark, d))


@query(
    "share_of_total",
    sql(
        "SELECT layer, v, n, n / sum(n) OVER (PARTITION BY layer) * 100 AS percent FROM "
        "(SELECT layer, v, count(*) AS n FROM cells GROUP BY 1, 2)"
    ),
)
def share_of_total(spark, d):
    return build_rat(grid.cells(spark, d), "layer").withColumn("percent", share("n", "layer"))


@query(
    "perc_of_t1",
    sql(
        "SELECT v, n, CASE WHEN v IN (1, 2, 3) THEN n / sum(n) FILTER (WHERE v IN (1, 2, 3)) OVER () * 100 END "
        "AS perc_of_t1_area FROM sums",
        SUMMARY_RAT,
    ),
)
def perc_of_t1(spark, d):
    return summary_rat(spark, d).withColumn("perc_of_t1_area", share("n", where=F.col("v").isin(1, 2, 3)))


@query(
    "first_last_area",
    sql("SELECT v, arg_min(Area_ha, year) AS first_ha, arg_max(Area_ha, year) AS last_ha FROM long GROUP BY v", *GEN_LONG),
)
def first_last_area(spark, d):
    return gen_long(spark, d).groupBy("v").agg(
        F.min_by("Area_ha", "year").alias("first_ha"), F.max_by("Area_ha", "year").alias("last_ha")
    )


_ORDER_YEARS = "years AS (SELECT year(o_orderdate) AS year FROM orders)"


def _order_years(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.year("o_orderdate").alias("year"))


@query(
    "year_pairs",
    sql(
        "SELECT DISTINCT CAST(y1 AS INTEGER) AS y1, CAST(y2 AS INTEGER) AS y2 FROM (SELECT year AS y1, "
        "lead(year) OVER (ORDER BY year) AS y2 FROM (SELECT DISTINCT year FROM years) "
        "UNION ALL SELECT min(year), max(year) FROM years) WHERE y2 IS NOT NULL",
        _ORDER_YEARS,
    ),
)
def year_pairs(spark, d):
    return tabulate.year_pairs(_order_years(spark, d))


@query("sort_value_year", sql("SELECT v, year, Area_ha FROM long ORDER BY v, year", *GEN_LONG))
def sort_value_year(spark, d):
    return gen_long(spark, d).select("v", "year", "Area_ha").orderBy("v", "year")


@query(
    "sort_period_area",
    sql(
        "SELECT chg_years, to_from, chg_class, hectares FROM lossgain ORDER BY chg_years, to_from DESC, "
        "CASE WHEN gen_start = '99' THEN gen_end ELSE gen_start END", *GAINLOSS
    ),
)
def sort_period_area(spark, d):
    out = change.loss_gain(period_rat(spark, d), codes.FOREST, "Forest")
    # By the decade code as text, before it is given its name.
    other = F.when(F.col("gen_start") == "99", F.col("gen_end")).otherwise(F.col("gen_start"))
    out = out.orderBy("chg_years", F.desc("to_from"), other)
    return out.select("chg_years", "to_from", "chg_class", "hectares")


@query(
    "class_order",
    sql("SELECT CoverClass, y, CAST(row_number() OVER (ORDER BY y DESC, CoverClass) AS INTEGER) AS ord FROM stats", *GEN_LONG, STATS),
)
def class_order(spark, d):
    return tabulate.class_order(tabulate.class_period_stats(gen_long(spark, d)))


@query("sort_area_desc", sql("SELECT v, n, change_type, area_ha FROM to_from ORDER BY area_ha DESC, v", *TO_FROM))
def sort_area_desc(spark, d):
    return to_from(spark, d).drop("perc_area").orderBy(F.desc("area_ha"), "v")


@query("head_rows", sql("SELECT v, year, n FROM yearly ORDER BY v, year LIMIT 6", _YEARLY))
def head_rows(spark, d):
    return landscape.yearly_rat(grid.stack(spark, d), LAYERS).select("v", "year", "n").orderBy("v", "year").limit(6)


@query("first_k_classes", sql("SELECT v, CoverClass, Area_ha FROM long WHERE v BETWEEN 1 AND 5 AND year = 2021", *GEN_LONG))
def first_k_classes(spark, d):
    out = gen_summary(spark, d).filter(F.col("v").between(1, 5))
    return out.select("v", "CoverClass", F.col("Area_ha_2021").alias("Area_ha"))


@query(
    "min_max_year",
    sql("SELECT CAST(min(year) AS INTEGER) AS start_year, CAST(max(year) AS INTEGER) AS end_year FROM years", _ORDER_YEARS),
)
def min_max_year(spark, d):
    return _order_years(spark, d).agg(F.min("year").alias("start_year"), F.max("year").alias("end_year"))


# ---- set operations


@query(
    "stack_tables",
    sql(
        "SELECT v, n, 'classes' AS src, CAST(NULL AS DOUBLE) AS area_ha FROM lc_2001_rat UNION ALL "
        "SELECT v, n, 'change', n * 900 / 10000 FROM (SELECT lc_2001 * 100 + lc_2021 AS v, count(*) AS n FROM stack GROUP BY 1)",
        _rats("lc_2001"),
    ),
)
def stack_tables(spark, d):
    a = build_rat(grid.layer(spark, d, "lc_2001")).withColumn("src", F.lit("classes"))
    b = build_rat(change.change_cells(grid.stack(spark, d), "lc_2001", "lc_2021"))
    b = b.select(F.col("n"), F.col("v"), F.lit("change").alias("src"), col.area_ha_900("n").alias("area_ha"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "append_features",
    sql("SELECT feat_id, r, c FROM region UNION ALL SELECT 100 + c // 25, r, c FROM stack WHERE lc_2021 IN (41, 42, 43)"),
)
def append_features(spark, d):
    band = F.call_function("div", F.col("c"), F.lit(25)) + 100
    more = grid.layer(spark, d, "lc_2021").filter(F.col("v").isin(41, 42, 43))
    return grid.forest_regions(spark, d).unionByName(more.select(band.alias("feat_id"), "r", "c"))


@query(
    "comb_class_membership",
    sql(
        f"SELECT v, n, v IN {in_sql(codes.FOREST + codes.DEVELOPED)} AS inside, "
        f"v NOT IN {in_sql(codes.FOREST + codes.DEVELOPED)} AS outside FROM lc_2001_rat",
        _rats("lc_2001"),
    ),
)
def comb_class_membership(spark, d):
    both = F.col("v").isin(codes.FOREST + codes.DEVELOPED)
    return build_rat(grid.layer(spark, d, "lc_2001")).withColumns({"inside": both, "outside": ~both})


# ---- scalar functions

_LAYER_NAMES = ORDER_LAYERS


def _names(spark, d):
    return order_layers(spark, d).distinct()


@query(
    "str_substr",
    sql("SELECT layer, substr(layer, 1, 2) AS head, substr(layer, 4, 4) AS mid, right(layer, 4) AS tail, length(layer) AS size FROM names", _LAYER_NAMES),
)
def str_substr(spark, d):
    return _names(spark, d).select(
        "layer",
        F.substring("layer", 1, 2).alias("head"),
        F.substring("layer", 4, 4).alias("mid"),
        F.right("layer", F.lit(4)).alias("tail"),
        F.length("layer").cast("bigint").alias("size"),
    )


@query(
    "str_concat",
    sql("SELECT layer, layer || '_barren' AS barren, 'forest_dev_' || substr(layer, 4, 4) || '_2021' AS summary FROM names", _LAYER_NAMES),
)
def str_concat(spark, d):
    return _names(spark, d).select(
        "layer",
        F.concat("layer", F.lit("_barren")).alias("barren"),
        F.format_string("forest_dev_%s_2021", F.substring("layer", 4, 4)).alias("summary"),
    )


@query(
    "str_replace",
    sql("SELECT layer, replace(layer, '_', '-') AS dashed, replace(layer, '1997', '2021') AS moved FROM names", _LAYER_NAMES),
)
def str_replace(spark, d):
    return _names(spark, d).select(
        "layer",
        F.regexp_replace("layer", "_", "-").alias("dashed"),
        F.replace("layer", F.lit("1997"), F.lit("2021")).alias("moved"),
    )


@query(
    "str_match",
    sql(
        "SELECT layer, regexp_matches(layer, '1993|1995') AS listed, starts_with(layer, 'lc_') AS pre, "
        "suffix(layer, '3') AS post, contains(layer, '96') AS has FROM names",
        _LAYER_NAMES,
    ),
)
def str_match(spark, d):
    return _names(spark, d).select(
        "layer",
        F.col("layer").rlike("1993|1995").alias("listed"),
        F.startswith("layer", F.lit("lc_")).alias("pre"),
        F.endswith("layer", F.lit("3")).alias("post"),
        F.contains("layer", F.lit("96")).alias("has"),
    )


@query("pct_label", sql("SELECT CoverClass, year, label FROM pct", *GEN_LONG, PCT))
def pct_label(spark, d):
    return tabulate.lag_pct_change(gen_long(spark, d)).select("CoverClass", "year", "label")


@query(
    "number_label",
    sql(
        "SELECT chg_years, chg_class, CASE WHEN round(ha) > 0 THEN '+' ELSE '' END || "
        "format('{:,}', CAST(round(ha) AS BIGINT)) AS signed, printf('%.2f', ha / 1e6::DOUBLE) AS millions FROM net",
        *GAINLOSS,
    ),
)
def number_label(spark, d):
    out = change.net_change(period_rat(spark, d), codes.FOREST, "Forest", "2001-2021")
    return out.select(
        "chg_years",
        "chg_class",
        col.signed_number_label("ha").alias("signed"),
        col.millions_label("ha").alias("millions"),
    )


@query(
    "concat_code",
    sql(
        "SELECT start_class, end_class, n, CAST('41' || end_class AS INTEGER) AS code_from, "
        "CAST(start_class || '41' AS INTEGER) AS code_to FROM decoded",
        DETAILED,
        DECODED,
    ),
)
def concat_code(spark, d):
    rat = change.change_decode(build_rat(change.change_cells(grid.stack(spark, d), "lc_2001", "lc_2021")))
    return rat.select(
        "start_class",
        "end_class",
        "n",
        col.concat_code(F.lit(41), "end_class").alias("code_from"),
        col.concat_code("start_class", F.lit(41)).alias("code_to"),
    )


@query(
    "math_round",
    sql(
        "SELECT event_id, round(value, 2) AS r2, CAST(trunc(value) AS INTEGER) AS whole, "
        "value / 1e6::DOUBLE AS millions FROM events"
    ),
)
def math_round(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.select(
        "event_id",
        F.round("value", 2).alias("r2"),
        F.col("value").cast("int").alias("whole"),
        (F.col("value") / F.lit(1e6)).alias("millions"),
    )


@query(
    "scale_measure",
    sql(
        f"SELECT v, CAST(n AS DOUBLE) * 8 AS num, 'METERS' AS unit, {_plain_sql('CAST(n AS DOUBLE) * 8')} || ' METERS' AS text "
        "FROM lc_2001_rat",
        _rats("lc_2001"),
    ),
)
def scale_measure(spark, d):
    rat = build_rat(grid.layer(spark, d, "lc_2001"))
    text = rat.withColumn("m", F.concat(F.col("n").cast("string"), F.lit(" METERS")))
    return text.withColumn("m", col.scale_measure("m", 8)).select("v", "m.num", "m.unit", "m.text")


@query(
    "elapsed_text",
    "SELECT user_id, printf('%d days, %d hours, %d minutes, %d seconds', s // 86400, s // 3600 % 24, s // 60 % 60, s % 60) "
    "AS elapsed FROM (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS s FROM events GROUP BY user_id)",
)
def elapsed_text(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    spans = ev.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("user_id", col.elapsed_text("a", "b").alias("elapsed"))


@query(
    "map_lookup",
    sql("SELECT v, n, d.label AS detailed, g.label AS general FROM lc_2001_rat LEFT JOIN detailed d ON v = d.code "
        "LEFT JOIN general g ON v = g.code", DETAILED, GENERAL, _rats("lc_2001")),
)
def map_lookup(spark, d):
    rat = build_rat(grid.layer(spark, d, "lc_2001"))
    return rat.withColumns(
        {"detailed": col.lookup_label("v", codes.DETAILED), "general": col.lookup_label("v", codes.GENERAL)}
    )


@query("in_list", sql(f"SELECT r, c, lc_2021 IN {_F} AS forest FROM stack"))
def in_list(spark, d):
    return grid.layer(spark, d, "lc_2021").select("r", "c", F.col("v").isin(codes.FOREST).alias("forest"))


# ---- reshapes


@query(
    "unpivot_area",
    sql("SELECT v, CoverClass, name, Area_ha, year FROM long", DETAILED, _YEARLY, _LONG_FULL),
)
def unpivot_area(spark, d):
    rat = landscape.yearly_rat(grid.stack(spark, d), LAYERS)
    return tabulate.unpivot_area(tabulate.tab_lc_types(rat, YEARS, "NLCD"))


@query(
    "pivot_years",
    sql(
        "SELECT v, " + ", ".join(
            f"100 * any_value(n) FILTER (WHERE year = {y}) / total AS Percent_{y}, "
            f"any_value(n) FILTER (WHERE year = {y}) * 0.09::DOUBLE AS Area_ha_{y}, "
            f"any_value(n) FILTER (WHERE year = {y}) * 0.2223948429::DOUBLE AS Area_ac_{y}"
            for y in YEARS
        ) + " FROM yearly, (SELECT CAST(sum(n) AS BIGINT) AS total FROM yearly WHERE year = 2001) GROUP BY v, total",
        _YEARLY,
    ),
)
def pivot_years(spark, d):
    return tabulate.pivot_years(landscape.yearly_rat(grid.stack(spark, d), LAYERS), YEARS)


@query(
    "general_trend",
    sql("SELECT v, CoverClass, year, Area_ha / 1e6::DOUBLE AS millions FROM long WHERE v BETWEEN 1 AND 5", *GEN_LONG),
)
def general_trend(spark, d):
    return tabulate.general_trend(gen_summary(spark, d))

