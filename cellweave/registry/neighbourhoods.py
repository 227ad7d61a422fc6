"""Focal, distance and barren queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.functions.columns import indicator
from cellweave.operators import neighbourhood as near
from cellweave.operators.distance import distance_transform
from cellweave.operators.tiles import circle, square
from cellweave.plans import barren, landscape
from cellweave.plans.proportions import lc_proportions, lc_proportions_years
from cellweave.registry.base import GENERAL, query, remap_sql, sql
from cellweave.registry.projections import INDICATOR_SQL
from cellweave.registry.scans import EDGES_SQL, INSIDE_SQL, POINTS_SQL, study_edges
from cellweave.registry.tables import yearly_sql
from cellweave.session import div
from cellweave.sources import events_grid as grid

_OFF = "off AS (SELECT a.d AS dr, b.d AS dc FROM range(-{n}, {n} + 1) a(d), range(-{n}, {n} + 1) b(d))"


def square_sql(n: int) -> str:
    return _OFF.format(n=n)


def disk_sql(cells: float, name: str = "disk") -> str:
    """Offsets within a distance, in cells."""
    n = int(cells)
    return (
        f"{name} AS (SELECT a.d AS dr, b.d AS dc FROM range(-{n}, {n} + 1) a(d), range(-{n}, {n} + 1) b(d) "
        f"WHERE a.d * a.d + b.d * b.d <= {cells * cells})"
    )


# So small that neighbourhoods cross tiles in both directions on the smallest grid.
TILE = 8

_FOREST = "src AS (SELECT r, c, CASE lc_2001 WHEN 41 THEN 100 WHEN 43 THEN 50 WHEN 0 THEN NULL ELSE 0 END AS v FROM stack)"


def _forest(spark, d):
    v = indicator(F.nullif("lc_2001", F.lit(0)), "dfr")
    return grid.stack(spark, d, "lc_2001").select("r", "c", v.alias("v"))


@query(
    "focal_mean_3x3",
    sql(
        "SELECT r, c, CAST(sum(y.v) AS BIGINT) / count(y.v) AS mean FROM src x "
        "JOIN (SELECT r + dr AS r, c + dc AS c, v FROM src, off) y USING (r, c) GROUP BY r, c",
        _FOREST,
        square_sql(1),
    ),
)
def focal_mean_3x3(spark, d):
    return near.focal_mean_square(_forest(spark, d), tile=TILE)


def _circle_sql(radius: int, source: str = _FOREST) -> str:
    return sql(
        f"SELECT x.r, x.c, CAST(sum(y.v) AS BIGINT) / nullif(count(y.v), 0) AS mean FROM src x JOIN src y "
        f"ON y.r BETWEEN x.r - {radius} AND x.r + {radius} "
        f"AND (y.r - x.r) * (y.r - x.r) + (y.c - x.c) * (y.c - x.c) <= {radius * radius} GROUP BY x.r, x.c",
        source,
    )


def _circle(radius: int, tile: int, width: int = 100):
    def run(spark, d):
        cells = _forest(spark, d)
        number = F.col("r") * 100 + F.col("c")
        wide = cells.select(div(number, width).alias("r"), F.pmod(number, F.lit(width)).alias("c"), "v")
        means = near.focal_means(wide, ["v"], {"mean": circle(radius)}, tile)
        return means.withColumnRenamed("vmean", "mean")

    return run


# The widest neighbourhood needs a wider grid to cross tiles: the same cells in rows of 500.
_WIDE = _FOREST.replace("SELECT r, c,", "SELECT (r * 100 + c) // 500 AS r, (r * 100 + c) % 500 AS c,")

query("focal_mean_c10", _circle_sql(10))(_circle(10, 16))
query("focal_mean_c100", _circle_sql(100, _WIDE))(_circle(100, 104, 500))


@query(
    "focal_majority",
    sql(
        "SELECT s.r, s.c, m.majority FROM stack s LEFT JOIN (SELECT r, c, v AS majority FROM "
        "(SELECT r, c, v, row_number() OVER (PARTITION BY r, c ORDER BY count(*) DESC, v) AS i "
        "FROM (SELECT r + dr AS r, c + dc AS c, lc_2001 AS v FROM stack, off) GROUP BY r, c, v) WHERE i = 1) m "
        "USING (r, c)",
        square_sql(1),
    ),
)
def focal_majority(spark, d):
    return near.focal_majority(grid.layer(spark, d, "lc_2001"), tile=TILE)


_DIST = (
    "dist AS (SELECT r + dr AS r, c + dc AS c, min(30 * sqrt(CAST(dr * dr + dc * dc AS DOUBLE))) AS dist "
    "FROM stack, off WHERE lc_1992 = 32 AND 900 * (dr * dr + dc * dc) < 10000 GROUP BY 1, 2)"
)


@query(
    "euclid_distance",
    sql("SELECT r, c, dist FROM stack LEFT JOIN dist USING (r, c)", square_sql(3), _DIST),
)
def euclid_distance(spark, d):
    return near.euclid_distance(grid.layer(spark, d, "lc_1992"), 32, 100.0, tile=TILE)


@query(
    "within_distance",
    sql("SELECT r, c, dist IS NOT NULL AS near FROM stack LEFT JOIN dist USING (r, c)", square_sql(3), _DIST),
)
def within_distance(spark, d):
    return near.within_distance(grid.layer(spark, d, "lc_1992"), 32, 100.0, tile=TILE)


_RARE = "event_id % 1709 = 111"


@query(
    "euclid_distance_far",
    sql(
        f"SELECT s.r, s.c, min(30 * sqrt(CAST((s.r - f.r) * (s.r - f.r) + (s.c - f.c) * (s.c - f.c) AS DOUBLE))) AS dist "
        f"FROM stack s, (SELECT r, c FROM ev WHERE {_RARE}) f GROUP BY s.r, s.c"
    ),
)
def euclid_distance_far(spark, d):
    """Distances to a few cells; bands are low, so that most distances span many of them."""
    ev = spark.read.parquet(f"{d}/events.parquet")
    cells = ev.select(div(F.col("event_id"), 100).alias("r"), F.pmod("event_id", F.lit(100)).alias("c"), F.expr(_RARE).alias("rare"))
    return distance_transform(cells, F.col("rare"), band_cells=400)


@query(
    "expand_class",
    sql(
        "SELECT s.r, s.c, CASE WHEN g.r IS NOT NULL THEN 31 ELSE s.lc_2001 END AS expanded FROM stack s "
        "LEFT JOIN (SELECT DISTINCT y.r + dr AS r, y.c + dc AS c FROM stack y, off WHERE y.lc_2001 = 31) g "
        "ON s.r = g.r AND s.c = g.c",
        square_sql(3),
    ),
)
def expand_class(spark, d):
    return near.expand_class(grid.layer(spark, d, "lc_2001"), 31, 3, tile=TILE)


def _barren_ctes(year: int, current: str, ref: str, table: dict) -> list[str]:
    """One year of the barren rule by plain offset joins."""
    p = f"y{year}_"
    return [
        f"{p}in AS (SELECT s.r, s.c, s.{current} AS cur, f.ref FROM stack s JOIN {ref} f USING (r, c))",
        f"{p}rc AS (SELECT r, c, {remap_sql('ref', table)} AS v FROM {p}in)",
        f"{p}maj AS (SELECT r, c, v FROM (SELECT r, c, v, row_number() OVER (PARTITION BY r, c "
        f"ORDER BY count(*) DESC, v) AS i FROM (SELECT r + dr AS r, c + dc AS c, v FROM {p}rc, off1) "
        f"SEMI JOIN {p}rc USING (r, c) WHERE v IS NOT NULL GROUP BY r, c, v) WHERE i = 1)",
        f"{p}exp AS (SELECT DISTINCT y.r + dr AS r, y.c + dc AS c FROM {p}maj y, off3 WHERE y.v = 31)",
        f"{p}near AS (SELECT DISTINCT y.r + dr AS r, y.c + dc AS c FROM {p}in y, off3 "
        f"WHERE y.ref = 32 AND 900 * (dr * dr + dc * dc) < 10000)",
        f"{p}out AS (SELECT i.r, i.c, CAST(CASE WHEN cur <> 31 OR cur IS NULL THEN cur WHEN ref = 31 THEN 31 "
        f"WHEN ref = 32 THEN 32 WHEN ref IS NULL THEN NULL WHEN n.r IS NOT NULL THEN 32 WHEN e.r IS NOT NULL THEN 31 "
        f"ELSE m.v END AS INTEGER) AS ref FROM {p}in i LEFT JOIN {p}maj m USING (r, c) LEFT JOIN {p}exp e USING (r, c) "
        f"LEFT JOIN {p}near n USING (r, c))",
    ]


_OFFS = [square_sql(1).replace("off AS", "off1 AS"), square_sql(3).replace("off AS", "off3 AS")]
_REF92 = "ref92 AS (SELECT r, c, lc_1992 AS ref FROM stack)"
_SPLIT = _barren_ctes(2001, "lc_2001", "ref92", codes.BARREN_FROM_1992)


@query(
    "barren_split",
    sql(
        "SELECT r, c, ref AS v, label AS CoverClass FROM y2001_out LEFT JOIN detailed ON ref = code",
        *_OFFS, _REF92, *_SPLIT,
        "detailed(code, label) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in codes.DETAILED.items()) + ")",
    ),
)
def barren_split(spark, d):
    st = grid.stack(spark, d, "lc_2001", "lc_1992")
    return landscape.labelled(barren.barren_split(st, "lc_2001", "lc_1992", "1992", tile=TILE), "NLCD")


def _chain_ctes(years):
    ctes, ref, table = list(_OFFS) + [_REF92], "ref92", codes.BARREN_FROM_1992
    for y in years:
        ctes += _barren_ctes(y, f"lc_{y}", ref, table)
        ref, table = f"y{y}_out", codes.BARREN_FROM_STANDARD
    return ctes


def _materialised(ctes):
    return [c.replace(" AS (SELECT", " AS MATERIALIZED (SELECT", 1) for c in ctes]


CHAIN = _materialised(_chain_ctes(codes.YEARS))
CHAIN_TILE = 40  # above the halo of nine years


@query(
    "barren_chain",
    sql(
        "SELECT r, c, " + ", ".join(f"y{y}_out.ref AS b_{y}" for y in codes.YEARS) + " FROM y2001_out "
        + " ".join(f"JOIN y{y}_out USING (r, c)" for y in codes.YEARS[1:]),
        *CHAIN,
    ),
)
def barren_chain(spark, d):
    return barren.barren_chain(grid.stack(spark, d), codes.YEARS, tile=CHAIN_TILE)


def _landscape_sql(clip: str, *ctes: str) -> str:
    years = " UNION ALL ".join(
        f"SELECT {y} AS year, {remap_sql('ref', codes.TO_GENERAL)} AS v FROM y{y}_out {clip}" for y in codes.YEARS
    )
    return sql(
        yearly_sql("yearly", label="general"),
        *CHAIN,
        GENERAL,
        *ctes,
        f"yearly AS (SELECT year, v, count(*) AS n FROM ({years}) WHERE v IS NOT NULL GROUP BY 1, 2)",
    )


@query("landscape_run", _landscape_sql(""))
def landscape_run(spark, d):
    return landscape.landscape_run(grid.stack(spark, d), codes.YEARS, tile=CHAIN_TILE)


@query(
    "landscape_run_clipped",
    _landscape_sql("SEMI JOIN inside USING (r, c)", POINTS_SQL, EDGES_SQL, INSIDE_SQL),
)
def landscape_run_clipped(spark, d):
    """The table counts the cells inside the study polygon; the barren rule sees those around it."""
    return landscape.landscape_run(grid.stack(spark, d), codes.YEARS, study_edges(spark, d), tile=CHAIN_TILE)


@query(
    "disturbance_run",
    sql(
        yearly_sql("yearly", label="general"),
        GENERAL,
        "yearly AS (SELECT year, v, count(*) AS n FROM ("
        + " UNION ALL ".join(
            f"SELECT {y} AS year, {remap_sql('v', codes.TO_GENERAL)} AS v FROM "
            f"(SELECT CASE WHEN lc_{y} IN (52, 71) AND chg = 11 THEN lc_{y} + 4 ELSE lc_{y} END AS v FROM stack)"
            for y in codes.YEARS
        )
        + ") WHERE v IS NOT NULL GROUP BY 1, 2)",
    ),
)
def disturbance_run(spark, d):
    return landscape.disturbance_run(grid.stack(spark, d), codes.YEARS)


_LAYER_NAMES = [*codes.INDICATORS, "impsur", "canopy"]
_INPUTS = (
    f"inputs AS (SELECT r, c, {INDICATOR_SQL}, nullif(impsur, 127) AS impsur, nullif(canopy, 255) AS canopy FROM stack)"
)


def _sums_sql(name: str, on: str) -> str:
    cols = ", ".join(
        f"CAST(sum(y.{x}) AS BIGINT) / nullif(count(y.{x}), 0) AS {x}" for x in _LAYER_NAMES
    )
    return f"{name} AS (SELECT x.r, x.c, {cols} FROM inputs x JOIN inputs y ON {on} GROUP BY x.r, x.c)"


def _within(radius: int) -> str:
    return (
        f"y.r BETWEEN x.r - {radius} AND x.r + {radius} "
        f"AND (y.r - x.r) * (y.r - x.r) + (y.c - x.c) * (y.c - x.c) <= {radius * radius}"
    )


def _scaled_sql(x: str, shape: str) -> str:
    k = 100 if x in codes.PERCENT_LAYERS else 10000
    return f"CAST(floor(coalesce(n{shape}.{x}, 0) * {k} + 0.5) AS INTEGER) AS {x}{shape}"


_OUT = [f"{x}{s}" for x in _LAYER_NAMES for s in ("1", "10", "100")]


@query(
    "lc_proportions",
    sql(
        "SELECT r, c, name, v FROM (SELECT m.r, m.c, "
        + ", ".join(_scaled_sql(x, s) for x in _LAYER_NAMES for s in ("1", "10", "100"))
        + " FROM mask m JOIN n1 USING (r, c) JOIN n10 USING (r, c) JOIN n100 USING (r, c)) "
        + f"UNPIVOT (v FOR name IN ({', '.join(_OUT)}))",
        _INPUTS,
        _sums_sql("n1", "y.r BETWEEN x.r - 1 AND x.r + 1 AND y.c BETWEEN x.c - 1 AND x.c + 1"),
        _sums_sql("n10", _within(10)),
        _sums_sql("n100", _within(100)),
    ),
)
def lc_proportions_query(spark, d):
    st = grid.stack(spark, d, "lc_2001", "impsur", "canopy")
    return lc_proportions(st, "lc_2001", grid.study_mask(spark, d))


# The years of the loop; one of them lacks an impervious layer.
_LOOP_YEARS = (2001, 2006, 2011, 2016)
_NO_IMPERVIOUS = 2011


def _years_sql(known: str, shapes: dict[str, str], years=_LOOP_YEARS, *ctes: str, source="stack", mask="mask") -> str:
    """Scaled means of some years; ``known`` tells which cells are in the study area."""
    table = {k: {c: codes.INDICATORS[k].get(c, 0) for c in codes.INDICATOR_CODES} for k in codes.INDICATORS}
    inputs = [
        f"CASE WHEN {known} THEN {remap_sql(f'lc_{y}', codes_of, False)} END AS y{y}_{k}"
        for y in years
        for k, codes_of in table.items()
    ]
    inputs += [f"CASE WHEN {known} THEN nullif(impsur, 127) END AS y{y}_impsur" for y in years if y != _NO_IMPERVIOUS]
    names = [x.split(" AS ")[-1] for x in inputs]

    def means(shape, on):
        cols = ", ".join(f"CAST(sum(y.{x}) AS BIGINT) / nullif(count(y.{x}), 0) AS {x}" for x in names)
        return f"n{shape} AS (SELECT x.r, x.c, {cols} FROM inputs x JOIN inputs y ON {on} GROUP BY x.r, x.c)"

    outs = [
        f"CAST(floor(coalesce(n{s}.{x}, 0) * {100 if x.split('_')[1] in codes.PERCENT_LAYERS else 10000} + 0.5) "
        f"AS INTEGER) AS {x}{s}"
        for x in names
        for s in shapes
    ]
    listed = ", ".join(f"{x}{s}" for x in names for s in shapes)
    joins = " ".join(f"JOIN n{s} USING (r, c)" for s in shapes)
    return sql(
        "SELECT CAST(substr(layer, 2, 4) AS INTEGER) AS year, substr(layer, 7) AS name, r, c, v FROM "
        f"(SELECT m.r, m.c, {', '.join(outs)} FROM {mask} m {joins}) UNPIVOT (v FOR layer IN ({listed}))",
        *ctes,
        f"inputs AS (SELECT {source}.r, {source}.c, {', '.join(inputs)} FROM {source})",
        *[means(s, on) for s, on in shapes.items()],
    )


_SQUARE = "y.r BETWEEN x.r - 1 AND x.r + 1 AND y.c BETWEEN x.c - 1 AND x.c + 1"


def _loop_years(years=_LOOP_YEARS):
    return {y: (f"lc_{y}", None if y == _NO_IMPERVIOUS else "impsur", None) for y in years}


@query(
    "lc_proportions_years",
    _years_sql("true", {"1": _SQUARE, "10": _within(10), "100": _within(100)}),
)
def lc_proportions_years_query(spark, d):
    """The loop as it is run: four years, three radii, a study polygon grown by 5,000 metres, which covers the grid."""
    st, mask = grid.stack(spark, d, *[f"lc_{y}" for y in _LOOP_YEARS], "impsur"), grid.study_mask(spark, d)
    return lc_proportions_years(st, _loop_years(), mask, edges=study_edges(spark, d), buffer=5000.0)


@query(
    "lc_proportions_area",
    _years_sql("c BETWEEN 28 AND 62", {"1": _SQUARE, "10": _within(10)}, (2001, 2011)),
)
def lc_proportions_area(spark, d):
    """A study area smaller than the mask, grown by 60 metres: masked cells outside it keep a mean."""
    st, mask = grid.stack(spark, d, "lc_2001", "lc_2011", "impsur"), grid.study_mask(spark, d)
    area = mask.filter(F.col("c").between(30, 60))
    shapes = {"1": square(1), "10": circle(10)}
    years = _loop_years((2001, 2011))
    return lc_proportions_years(st, years, mask, area=area, buffer=60.0, shapes=shapes, tile=16)


# A polygon of 100 columns on the same cells in rows of 1000: 5,000 metres reach 166 columns on both sides of it.
_STRIP = "wide AS (SELECT * REPLACE ((r * 100 + c) // 1000 AS r, (r * 100 + c) % 1000 AS c) FROM stack)"
_NEAR_STRIP = "power(greatest(400 - c, c - 499, 0), 2) + power(greatest(r - 199, 0), 2) <= 27777"


@query(
    "lc_proportions_buffered",
    _years_sql(
        _NEAR_STRIP, {"1": _SQUARE, "10": _within(10)}, (2001, 2011), _STRIP,
        "within AS (SELECT r, c FROM wide WHERE c BETWEEN 3 AND 996)", source="wide", mask="within",
    ),
)
def lc_proportions_buffered(spark, d):
    """The loop on a grid wider than the buffer of 5,000 metres around its study polygon."""
    st = grid.stack(spark, d, "lc_2001", "lc_2011", "impsur")
    number = F.col("r") * 100 + F.col("c")
    st = st.withColumns({"r": div(number, 1000), "c": F.pmod(number, F.lit(1000))})
    corners = [(12000.0, 0.0), (15000.0, 0.0), (15000.0, 6000.0), (12000.0, 6000.0)]
    sides = [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]
    edges = spark.createDataFrame(sides, "x1 double, y1 double, x2 double, y2 double")
    mask = st.filter(F.col("c").between(3, 996)).select("r", "c")
    shapes = {"1": square(1), "10": circle(10)}
    return lc_proportions_years(st, _loop_years((2001, 2011)), mask, edges=edges, buffer=5000.0, shapes=shapes, tile=64)
