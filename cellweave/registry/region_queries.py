"""Region queries: parts, buffers, holes, closing, opening, wraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import regions
from cellweave.operators.components import label_parts
from cellweave.operators.runs import to_cells, to_runs
from cellweave.registry.base import query, sql
from cellweave.registry.neighbourhoods import disk_sql
from cellweave.sources import events_grid as grid

_EIGHT = "eight AS (SELECT a.d AS dr, b.d AS dc FROM range(-1, 2) a(d), range(-1, 2) b(d))"
_FOUR = "four AS (SELECT dr, dc FROM eight WHERE abs(dr) + abs(dc) = 1)"


def parts_sql(name: str, source: str, keys: str = "") -> str:
    """Cells of ``source`` with the first cell of their 8-connected part, by label spreading."""
    k = f"{keys}, " if keys else ""
    ak = "".join(f"a.{x}, " for x in keys.split(", ") if x)
    nk = "".join(f"s.{x}, " for x in keys.split(", ") if x)
    return (
        f"{name}_lab({k}r, c, l) USING KEY ({k}r, c) AS (SELECT {k}r, c, r * 1000000 + c + 1000 FROM {source} UNION "
        f"SELECT {ak}a.r, a.c, min(s.l) FROM (SELECT {nk}s.r + dr AS r, s.c + dc AS c, s.l FROM {name}_lab s, eight) s "
        f"JOIN recurring.{name}_lab a USING ({k}r, c) WHERE s.l < a.l GROUP BY {ak}a.r, a.c), "
        f"{name} AS (SELECT {k}CAST(floor(l / 1000000) AS BIGINT) AS part_r, "
        f"l - CAST(floor(l / 1000000) AS BIGINT) * 1000000 - 1000 AS part_c, r, c FROM {name}_lab)"
    )


_HEAD = (_EIGHT, _FOUR)

# So small that parts cross tiles in both directions on the smallest grid.
TILE = 8


@query(
    "explode_parts",
    sql("SELECT * FROM parts", *_HEAD, parts_sql("parts", "region", "feat_id"), recursive=True),
)
def explode_parts(spark, d):
    return regions.explode_parts(grid.forest_regions(spark, d), tile=TILE)


@query("dissolve_parts", sql("SELECT * FROM parts", *_HEAD, parts_sql("parts", "region"), recursive=True))
def dissolve_parts(spark, d):
    return regions.dissolve_parts(grid.forest_regions(spark, d), tile=TILE)


@query(
    "mask_semi",
    sql(
        "SELECT * FROM parts", *_HEAD, "clipped AS (SELECT * FROM region SEMI JOIN mask USING (r, c))",
        parts_sql("parts", "clipped", "feat_id"), recursive=True,
    ),
)
def mask_semi(spark, d):
    return regions.clean_clip(grid.forest_regions(spark, d), grid.study_mask(spark, d), tile=TILE)


_WATER = "water AS (SELECT r, c FROM stack WHERE lc_2021 IN (11, 21, 22, 81))"


def _water(spark, d):
    return grid.layer(spark, d, "lc_2021").filter(F.col("v").isin(11, 21, 22, 81))


@query(
    "mask_anti",
    sql(
        "SELECT * FROM parts", *_HEAD, _WATER, "kept AS (SELECT * FROM region ANTI JOIN water USING (r, c))",
        parts_sql("parts", "kept", "feat_id"), recursive=True,
    ),
)
def mask_anti(spark, d):
    return regions.clean_erase(grid.forest_regions(spark, d), _water(spark, d), tile=TILE)


@query(
    "select_by_location",
    sql("SELECT DISTINCT feat_id FROM region SEMI JOIN water USING (r, c)", _WATER),
)
def select_by_location(spark, d):
    return regions.select_by_location(grid.forest_regions(spark, d), _water(spark, d))


@query(
    "buffer_dilate",
    sql("SELECT DISTINCT r + dr AS r, c + dc AS c FROM region, disk", disk_sql(2.0)),
)
def buffer_dilate(spark, d):
    return regions.buffer_dilate(grid.forest_regions(spark, d), 60.0)


@query(
    "buffer_dilate_features",
    sql("SELECT DISTINCT feat_id, r + dr AS r, c + dc AS c FROM region, disk", disk_sql(2.0)),
)
def buffer_dilate_features(spark, d):
    return regions.buffer_dilate(grid.forest_regions(spark, d), 60.0, merge=False)


def _erode_sql(name: str, source: str, keys: str, disk: str) -> str:
    k = f"{keys}, " if keys else ""
    return (
        f"{name} AS (SELECT {k}r, c FROM (SELECT {k}r - dr AS r, c - dc AS c FROM {source}, {disk}) "
        f"GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM {disk}))"
    )


@query(
    "buffer_erode",
    sql("SELECT * FROM eroded", disk_sql(1.0), _erode_sql("eroded", "region", "feat_id", "disk")),
)
def buffer_erode(spark, d):
    return regions.buffer_erode(grid.forest_regions(spark, d), 30.0)


def holes_sql(name: str, parts: str, keys: str, having: str) -> str:
    """Cells of the contained gaps of each part that pass ``having``.

    A flood from a margin around the part reaches every other gap; what it does
    not reach is labelled and measured.
    """
    k = [x for x in keys.split(", ") if x] + ["part_r", "part_c"]
    ks, on = ", ".join(k), ", ".join([*k, "r", "c"])
    a = "".join(f"a.{x}, " for x in k)
    p = name
    return (
        f"{p}_box AS (SELECT {ks}, min(r) - 1 AS r0, max(r) + 1 AS r1, min(c) - 1 AS c0, max(c) + 1 AS c1, "
        f"count(*) AS solid FROM {parts} GROUP BY {ks}), "
        f"{p}_rows AS (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM {p}_box), "
        f"{p}_all AS (SELECT {ks}, r, unnest(range(c0, c1 + 1)) AS c, r0, r1, c0, c1 FROM {p}_rows), "
        f"{p}_free AS (SELECT * FROM {p}_all ANTI JOIN {parts} USING ({on})), "
        f"{p}_sea({on}) AS (SELECT {on} FROM {p}_free WHERE r IN (r0, r1) OR c IN (c0, c1) UNION "
        f"SELECT {a}a.r, a.c FROM (SELECT {', '.join('s.' + x for x in k)}, s.r + dr AS r, s.c + dc AS c FROM {p}_sea s, four) s "
        f"JOIN {p}_free a USING ({on})), "
        f"{p}_gap AS (SELECT {on} FROM {p}_free ANTI JOIN {p}_sea USING ({on})), "
        f"{p}_lab({on}, l) USING KEY ({on}) AS (SELECT {on}, r * 1000000 + c + 1000 FROM {p}_gap UNION "
        f"SELECT {a}a.r, a.c, min(s.l) FROM (SELECT {', '.join('s.' + x for x in k)}, s.r + dr AS r, s.c + dc AS c, s.l "
        f"FROM {p}_lab s, four) s JOIN recurring.{p}_lab a USING ({on}) WHERE s.l < a.l GROUP BY {a}a.r, a.c), "
        f"{p}_sized AS (SELECT {ks}, l, count(*) AS hole, sum(count(*)) OVER (PARTITION BY {ks}) AS inside "
        f"FROM {p}_lab GROUP BY {ks}, l), "
        f"{p}_pass AS (SELECT {ks}, l FROM {p}_sized JOIN {p}_box USING ({ks}) WHERE {having}), "
        f"{name} AS (SELECT {on} FROM {p}_lab SEMI JOIN {p}_pass USING ({ks}, l))"
    )


def _filled(below_area=None, below_percent=None):
    def run(spark, d):
        keys = ["feat_id"]
        parts = label_parts(to_runs(grid.forest_regions(spark, d), keys), keys, tile=TILE)
        return to_cells(regions.fill_holes(parts, keys, below_area, below_percent, tile=TILE))

    return run


def _filled_sql(having: str) -> str:
    return sql(
        "SELECT feat_id, part_r, part_c, r, c FROM parts UNION ALL SELECT feat_id, part_r, part_c, r, c FROM holes",
        *_HEAD, parts_sql("parts", "region", "feat_id"), holes_sql("holes", "parts", "feat_id", having), recursive=True,
    )


query("fill_holes_area", _filled_sql("hole * 900 < 1000"))(_filled(below_area=1000.0))
query("fill_holes_percent", _filled_sql("hole * 100 < (solid + inside) * 99"))(_filled(below_percent=99.0))


@query(
    "coalesce_regions",
    sql(
        "SELECT * FROM parts", *_HEAD, disk_sql(2.0),
        "big AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM region, disk)",
        _erode_sql("closed", "big", "", "disk"), parts_sql("parts", "closed"), recursive=True,
    ),
)
def coalesce_regions(spark, d):
    out = regions.coalesce_regions(grid.forest_regions(spark, d), 60.0, tile=TILE)
    return out.select("part_r", "part_c", "r", "c")


@query(
    "coalesce_regions_open",
    sql(
        "SELECT * FROM parts", *_HEAD, disk_sql(1.0), _erode_sql("small", "region", "feat_id", "disk"),
        "opened AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM small, disk)",
        parts_sql("parts", "opened"), recursive=True,
    ),
)
def coalesce_regions_open(spark, d):
    out = regions.coalesce_regions(grid.forest_regions(spark, d), -30.0, tile=TILE)
    return out.select("part_r", "part_c", "r", "c")


@query(
    "shrink_wrap",
    sql(
        "SELECT wrap_r, wrap_c, part_r, part_c, r, c FROM parts UNION ALL SELECT wrap_r, wrap_c, part_r, part_c, r, c FROM holes",
        *_HEAD, disk_sql(1.0), disk_sql(8.0, "wide"),
        "solid AS (SELECT DISTINCT r, c FROM region)",
        "buffered AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM solid, disk)",
        parts_sql("wrap", "buffered"),
        "members AS (SELECT w.part_r AS wrap_r, w.part_c AS wrap_c, r, c FROM solid JOIN wrap w USING (r, c))",
        "grown AS (SELECT DISTINCT wrap_r, wrap_c, r + dr AS r, c + dc AS c FROM members, wide)",
        _erode_sql("closed", "grown", "wrap_r, wrap_c", "wide"),
        parts_sql("parts", "closed", "wrap_r, wrap_c"),
        holes_sql("holes", "parts", "wrap_r, wrap_c", "hole * 100 < (solid + inside) * 99"), recursive=True,
    ),
)
def shrink_wrap(spark, d):
    out = regions.shrink_wrap(grid.forest_regions(spark, d), 30.0, tile=TILE)
    return out.select("wrap_r", "wrap_c", "part_r", "part_c", "r", "c")
