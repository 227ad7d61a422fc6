"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.functions.columns import cover_class, layer_period, layer_year, lookup_label, reclass
from cellweave.model import GridSpec
from cellweave.operators import overlay
from cellweave.operators.tabulate import build_rat
from cellweave.plans.change import change_cells, change_counts
from cellweave.registry.base import GENERAL, query, remap_sql, sql, values_sql
from cellweave.session import shared_path
from cellweave.sources import cells as store
from cellweave.sources import events_grid as grid
from cellweave.streaming.ingest import ingest_available, ingest_batch

SPEC = GridSpec()
EXISTING = ["lc_2001", "lc_2004"]


def stored(spark, d, *layers):
    """Layers written by ``write_cells`` and read again."""
    path = shared_path(spark, "cells")
    store.write_cells(grid.cells(spark, d, *layers), path)
    return store.read_cells(spark, path)


@query("scan_cells", sql("SELECT layer, year, r, c, v FROM cells"))
def scan_cells(spark, d):
    return stored(spark, d)


@query("scan_rat", sql("SELECT lc_2001 AS v, count(*) AS n FROM stack WHERE lc_2001 <> 0 GROUP BY 1"))
def scan_rat(spark, d):
    g = grid.layer(spark, d, "lc_2001").withColumn("v", F.nullif("v", F.lit(0)))
    return build_rat(g)


# Names of yearly layers, a year for each order.
ORDER_LAYERS = "names AS (SELECT DISTINCT 'lc_' || CAST(year(o_orderdate) AS VARCHAR) AS layer FROM orders)"


def order_layers(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(F.concat(F.lit("lc_"), F.year("o_orderdate").cast("string")).alias("layer"))


@query(
    "list_layers",
    sql(
        "SELECT DISTINCT layer FROM cells WHERE regexp_matches(layer, '^lc_') "
        "AND regexp_matches(layer, '2001|2011|2021')"
    ),
)
def list_layers(spark, d):
    """Names of layers that were stored, from the block log: no cell is read."""
    path = shared_path(spark, "cells")
    store.write_cells(grid.cells(spark, d), path)
    return store.stored_layers(spark, path, "^lc_", "2001|2011|2021").select("layer")


@query(
    "stored_layers",
    sql(
        "SELECT layer, year, count(*) AS n, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, "
        "min(v) AS v0, max(v) AS v1, round(avg(v), 6) AS mean_v, round(stddev_pop(v), 6) AS std_v "
        "FROM cells SEMI JOIN mask USING (r, c) GROUP BY layer, year"
    ),
)
def stored_layers(spark, d):
    """Counts, extents and statistics of layers that arrived in two lots."""
    path, mask = shared_path(spark, "cells"), grid.study_mask(spark, d)
    cells = grid.cells(spark, d)
    ingest_batch(cells.filter("r % 4 < 2"), path, "first", mask)
    ingest_batch(cells, path, "second", mask)
    out = store.stored_layers(spark, path)
    return out.withColumns({x: F.round(x, 6) for x in ("mean_v", "std_v")})


_TAGGED = " UNION ALL ".join(
    f"SELECT lc_{a} * 100 + lc_{b} AS v, count(*) AS n, 'change_{a}_{b}' AS data, "
    f"'{a}-{b}' AS chg_years FROM stack GROUP BY 1"
    for a, b in codes.PERIODS
)


@query("scan_tagged", sql(_TAGGED))
def scan_tagged(spark, d):
    """The tables of all periods come from one scan; each row keeps the name of its table."""
    rat = change_counts(grid.stack(spark, d), codes.PERIODS)
    name = F.concat(F.lit("change_"), F.translate("period", "-", "_"))
    return rat.select("v", "n", name.alias("data")).withColumn("chg_years", layer_period("data"))


@query(
    "layer_year",
    sql(
        "SELECT DISTINCT layer, CAST(substr(layer, 4, 4) AS INTEGER) AS year, "
        "layer || '_general' AS out_name, right(replace(layer, '_', '-'), 7) AS tail FROM names",
        ORDER_LAYERS,
    ),
)
def layer_year_query(spark, d):
    names = order_layers(spark, d).distinct()
    return names.select(
        "layer",
        layer_year("layer").alias("year"),
        F.concat("layer", F.lit("_general")).alias("out_name"),
        F.right(F.translate("layer", "_", "-"), F.lit(7)).alias("tail"),
    )


_NEW = sql("SELECT layer, year, r, c, v FROM cells WHERE layer NOT IN ('lc_2001', 'lc_2004')")


@query("ingest_new_layers", _NEW)
def ingest_new_layers(spark, d):
    path = shared_path(spark, "cells")
    store.write_cells(grid.cells(spark, d, *EXISTING), path)
    return store.new_cells(grid.cells(spark, d), store.block_log(spark, path))


_STORED = sql("SELECT layer, year, r, c, v FROM cells SEMI JOIN mask USING (r, c)")


@query("ingest_stream", _STORED)
def ingest_stream(spark, d):
    """Layers arrive in two lots; the second lot repeats the first and is clipped once."""
    source, target = shared_path(spark, "arrivals"), shared_path(spark, "layers")
    checkpoint = shared_path(spark, "ingest")
    mask = grid.study_mask(spark, d)
    grid.cells(spark, d, *EXISTING).write.parquet(source)
    ingest_available(spark, source, target, checkpoint, "grids", mask)
    grid.cells(spark, d).write.mode("append").parquet(source)
    ingest_available(spark, source, target, checkpoint, "grids", mask)
    return store.read_cells(spark, target)


@query("ingest_batch", _STORED)
def ingest_batch_query(spark, d):
    target = shared_path(spark, "layers")
    mask = grid.study_mask(spark, d)
    ingest_batch(grid.cells(spark, d, *EXISTING), target, "first", mask)
    ingest_batch(grid.cells(spark, d), target, "second", mask)
    return store.read_cells(spark, target)


@query("ingest_late_cells", _STORED)
def ingest_late_cells(spark, d):
    """A layer arrives in two lots that overlap; the second adds what the first lacked."""
    target, mask = shared_path(spark, "layers"), grid.study_mask(spark, d)
    early = grid.cells(spark, d).filter((F.col("r") % 3 != 0) | (F.col("layer") == "lc_2004"))
    ingest_batch(early.filter(F.col("layer") != "lc_2021"), target, "first", mask)
    ingest_batch(grid.cells(spark, d), target, "second", mask)
    return store.read_cells(spark, target)


@query("clip_layer", sql("SELECT r, c, lc_2021 AS v FROM stack SEMI JOIN mask USING (r, c)"))
def clip_layer(spark, d):
    return overlay.clip_layer(grid.layer(spark, d, "lc_2021"), template=grid.study_mask(spark, d))


# A pentagon over the whole grid with a rectangular hole, in the grid's own metres.
POINTS_SQL = """size AS (SELECT CAST(max(r) + 1 AS DOUBLE) AS h FROM stack),
point AS (SELECT unnest([
{'ring': 0, 'seq': 0, 'x': 60.0, 'y': 0.0}, {'ring': 0, 'seq': 1, 'x': 2700.0, 'y': 0.0},
{'ring': 0, 'seq': 2, 'x': 2940.0, 'y': h * 15.0}, {'ring': 0, 'seq': 3, 'x': 2700.0, 'y': h * 30.0},
{'ring': 0, 'seq': 4, 'x': 60.0, 'y': h * 30.0}, {'ring': 0, 'seq': 5, 'x': 60.0, 'y': 0.0},
{'ring': 1, 'seq': 0, 'x': 900.0, 'y': h * 6.0}, {'ring': 1, 'seq': 1, 'x': 1500.0, 'y': h * 6.0},
{'ring': 1, 'seq': 2, 'x': 1500.0, 'y': h * 12.0}, {'ring': 1, 'seq': 3, 'x': 900.0, 'y': h * 12.0},
{'ring': 1, 'seq': 4, 'x': 900.0, 'y': h * 6.0}
], recursive := true) FROM size)"""


def study_points(spark, d):
    """Closed rings of the study area: an outline and a hole."""
    h = (F.max("r") + 1).cast("double")
    size = grid.stack(spark, d, "lc_2001").agg(h.alias("h"))
    outer = [(60.0, 0.0), (2700.0, 0.0), (2940.0, 15.0), (2700.0, 30.0), (60.0, 30.0), (60.0, 0.0)]
    hole = [(900.0, 6.0), (1500.0, 6.0), (1500.0, 12.0), (900.0, 12.0), (900.0, 6.0)]
    points = [
        F.struct(F.lit(i).alias("ring"), F.lit(k).alias("seq"), F.lit(x).alias("x"), (F.col("h") * y).alias("y"))
        for i, ring in enumerate((outer, hole))
        for k, (x, y) in enumerate(ring)
    ]
    return size.select(F.explode(F.array(*points)).alias("p")).select("p.*")


def study_edges(spark, d):
    return overlay.polygon_edges(study_points(spark, d))


@query(
    "polygon_edges",
    sql(
        "SELECT CAST(ring AS INTEGER) AS ring, CAST(x1 AS DOUBLE) AS x1, y1, CAST(x2 AS DOUBLE) AS x2, y2 FROM (SELECT ring, x AS x1, y AS y1, "
        "lead(x) OVER (PARTITION BY ring ORDER BY seq) AS x2, lead(y) OVER (PARTITION BY ring ORDER BY seq) AS y2 "
        "FROM point) WHERE x2 IS NOT NULL",
        POINTS_SQL,
    ),
)
def polygon_edges(spark, d):
    return study_edges(spark, d)


EDGES_SQL = """edge AS (SELECT x1, y1, x2, y2 FROM (SELECT x AS x1, y AS y1,
lead(x) OVER (PARTITION BY ring ORDER BY seq) AS x2, lead(y) OVER (PARTITION BY ring ORDER BY seq) AS y2
FROM point) WHERE x2 IS NOT NULL)"""

INSIDE_SQL = """inside AS (SELECT s.r, s.c FROM stack s JOIN edge e
ON least(y1, y2) <= s.r * 30.0::DOUBLE + 15 AND s.r * 30.0::DOUBLE + 15 < greatest(y1, y2)
AND x1 + (s.r * 30.0::DOUBLE + 15 - y1) * (x2 - x1) / (y2 - y1) <= s.c * 30.0::DOUBLE + 15
GROUP BY s.r, s.c HAVING count(*) % 2 = 1)"""


@query(
    "clip_layer_polygon",
    sql("SELECT r, c, lc_2021 AS v FROM stack SEMI JOIN inside USING (r, c)", POINTS_SQL, EDGES_SQL, INSIDE_SQL),
)
def clip_layer_polygon(spark, d):
    return overlay.clip_layer(grid.layer(spark, d, "lc_2021"), edges=study_edges(spark, d), spec=SPEC)


@query("polygon_mask", sql("SELECT r, c FROM inside", POINTS_SQL, EDGES_SQL, INSIDE_SQL))
def polygon_mask(spark, d):
    return overlay.polygon_mask(grid.stack(spark, d, "lc_2001").select("r", "c"), study_edges(spark, d), SPEC)


_NORTH = GridSpec(y0=3000.0, north_up=True)


@query(
    "polygon_mask_north_up",
    sql(
        "SELECT r, c FROM stack s JOIN edge e ON least(y1, y2) <= 3000 - (s.r * 30.0::DOUBLE + 15) "
        "AND 3000 - (s.r * 30.0::DOUBLE + 15) < greatest(y1, y2) "
        "AND x1 + (3000 - (s.r * 30.0::DOUBLE + 15) - y1) * (x2 - x1) / (y2 - y1) <= s.c * 30.0::DOUBLE + 15 "
        "GROUP BY r, c HAVING count(*) % 2 = 1",
        "edge(x1, y1, x2, y2) AS (VALUES (300.0::DOUBLE, 100.0::DOUBLE, 2800.0::DOUBLE, 700.0::DOUBLE), "
        "(2800.0, 700.0, 1500.0, 2990.0), (1500.0, 2990.0, 300.0, 100.0))",
    ),
)
def polygon_mask_north_up(spark, d):
    """A triangle on a grid whose rows run from north to south."""
    corners = [(300.0, 100.0), (2800.0, 700.0), (1500.0, 2990.0)]
    edges = [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]
    table = spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")
    return overlay.polygon_mask(grid.stack(spark, d, "lc_2001").select("r", "c"), table, _NORTH)


@query("write_cells", sql("SELECT layer, year, r, c, v FROM cells"))
def write_cells(spark, d):
    path = shared_path(spark, "cells")
    store.write_cells(grid.cells(spark, d), path)
    return store.read_cells(spark, path)


@query("write_table", sql("SELECT lc_2001 * 100 + lc_2021 AS v, count(*) AS n FROM stack GROUP BY 1"))
def write_table(spark, d):
    path = shared_path(spark, "table")
    store.write_table(build_rat(change_cells(grid.stack(spark, d), "lc_2001", "lc_2021")), path)
    return spark.read.parquet(path)


@query(
    "overwrite_mode",
    sql(
        "SELECT layer, year, r, c, CAST(CASE WHEN layer = 'lc_2004' THEN v + 100 ELSE v END AS INTEGER) AS v "
        "FROM cells WHERE layer IN ('lc_2001', 'lc_2004')"
    ),
)
def overwrite_mode(spark, d):
    """A layer written again replaces itself and leaves the other alone."""
    path = shared_path(spark, "cells")
    store.write_cells(grid.cells(spark, d, *EXISTING), path)
    again = grid.cells(spark, d, "lc_2004").withColumn("v", F.col("v") + 100)
    store.write_cells(again, path)
    return store.read_cells(spark, path)


@query(
    "attach_colormap",
    sql(
        f"SELECT g.v, g.n, n.label AS CoverClass, k.colour FROM (SELECT {remap_sql('lc_2001', codes.TO_GENERAL)} AS v, "
        "count(*) AS n FROM stack GROUP BY 1) g LEFT JOIN general n ON g.v = n.code "
        "LEFT JOIN colours k ON n.label = k.label WHERE g.v IS NOT NULL",
        GENERAL,
        values_sql("colours", "label, colour", codes.GENERAL_COLOURS.items()),
    ),
)
def attach_colormap(spark, d):
    g = grid.layer(spark, d, "lc_2001").withColumn("v", reclass("v", codes.TO_GENERAL))
    rat = build_rat(g).withColumn("CoverClass", cover_class("v", "Gen"))
    return rat.withColumn("colour", lookup_label("CoverClass", codes.GENERAL_COLOURS))


@query(
    "pyramid_level",
    sql(
        "SELECT r, c, CAST(v AS INTEGER) AS v FROM (SELECT r // 4 AS r, c // 4 AS c, lc_2001 AS v, "
        "row_number() OVER (PARTITION BY r // 4, c // 4 ORDER BY count(*) DESC, lc_2001) AS i "
        "FROM stack GROUP BY r // 4, c // 4, lc_2001) WHERE i = 1"
    ),
)
def pyramid_level(spark, d):
    return overlay.pyramid_level(grid.layer(spark, d, "lc_2001"), 4)


_LEVELS = 5


@query(
    "pyramid_levels",
    sql(
        "SELECT CAST(level AS INTEGER) AS level, r, c, CAST(v AS INTEGER) AS v FROM ("
        "SELECT k AS level, r >> k AS r, c >> k AS c, v, row_number() OVER (PARTITION BY k, r >> k, c >> k "
        "ORDER BY count(v) DESC, v) AS i FROM (SELECT r, c, nullif(lc_2001, 0) AS v, "
        f"unnest(generate_series(1, {_LEVELS})) AS k FROM stack) GROUP BY k, r >> k, c >> k, v) WHERE i = 1"
    ),
)
def pyramid_levels(spark, d):
    """Every level from one reading; squares are small, so that levels go on above them."""
    g = grid.layer(spark, d, "lc_2001").withColumn("v", F.nullif("v", F.lit(0)))
    return overlay.pyramid_levels(g, _LEVELS, side_bits=3)


_SCALES = {"fine": GridSpec(15.0, 15.0, 15.0), "same": GridSpec(60.0, -30.0, 30.0), "coarse": GridSpec(15.0, 15.0, 60.0)}


@query(
    "align_to_template",
    sql(
        "SELECT t.r, t.c, s.lc_2001 AS v FROM (SELECT DISTINCT r // 2 AS r, c // 2 AS c FROM stack) t "
        "LEFT JOIN stack s ON s.r = CAST(floor((15 + (t.r + 0.5::DOUBLE) * 60) / 30) AS BIGINT) "
        "AND s.c = CAST(floor((15 + (t.c + 0.5::DOUBLE) * 60) / 30) AS BIGINT)"
    ),
)
def align_to_template(spark, d):
    g = grid.layer(spark, d, "lc_2001")
    half = F.call_function("div", F.col("r"), F.lit(2)), F.call_function("div", F.col("c"), F.lit(2))
    template = g.select(half[0].alias("r"), half[1].alias("c")).distinct()
    return overlay.align_to_template(g, SPEC, template, GridSpec(15.0, 15.0, 60.0))


def _aligned_sql(name: str, spec: GridSpec) -> str:
    y, x = (f"{o} + (t.{k} + 0.5::DOUBLE) * {spec.size}" for o, k in ((spec.y0, "r"), (spec.x0, "c")))
    return (
        f"SELECT '{name}' AS scale, t.r, t.c, s.lc_2001 AS v FROM (SELECT r, c FROM stack) t LEFT JOIN stack s "
        f"ON s.r = CAST(floor(({y}) / 30) AS BIGINT) AND s.c = CAST(floor(({x}) / 30) AS BIGINT)"
    )


@query("align_scales", sql(" UNION ALL ".join(_aligned_sql(n, s) for n, s in _SCALES.items())))
def align_scales(spark, d):
    """A grid gathered at the cells of templates of half, equal and double its cell size."""
    g = grid.layer(spark, d, "lc_2001")
    out = None
    for name, spec in _SCALES.items():
        found = overlay.align_to_template(g, SPEC, g.select("r", "c"), spec).withColumn("scale", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out
