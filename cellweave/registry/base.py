"""Registration of queries with their SQL oracles, and the SQL all oracles share."""

from __future__ import annotations

from collections.abc import Callable

from cellweave.functions import codes
from cellweave.sources.events_grid import CODES_1992, LAYERS, codes_of

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` and its oracle, if any."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _class_sql(k: int) -> str:
    shift = (
        f"CASE WHEN event_type = 'purchase' AND {k} > user_id % 9 THEN 5 "
        f"WHEN event_type = 'error' AND {k} > user_id % 9 THEN 3 ELSE 0 END"
    )
    return (
        f"CAST(CASE WHEN event_id % 97 = 0 THEN 0 ELSE {codes_of(k)}[(b + {shift}) % 15 + 1] END AS INTEGER)"
    )


_STACK = ",\n".join(f"{_class_sql(k)} AS {name}" for k, name in enumerate(LAYERS))

GRID = f"""ev AS (
SELECT event_id, user_id, event_type, value, event_id // 100 AS r, event_id % 100 AS c,
((event_id // 100) // 6) * 7 + ((event_id % 100) // 9) * 11 AS b FROM events),
stack AS (SELECT r, c,
{_STACK},
CAST({CODES_1992}[(b + CASE WHEN event_type = 'signup' THEN user_id % 20 ELSE 0 END) % 20 + 1] AS INTEGER) AS lc_1992,
CAST(CASE WHEN event_id % 89 = 0 THEN 127 ELSE CAST(floor(value) AS INTEGER) % 101 END AS INTEGER) AS impsur,
CAST(CASE WHEN event_id % 83 = 0 THEN 255 ELSE user_id % 101 END AS INTEGER) AS canopy,
CASE WHEN event_type IN ('purchase', 'error') THEN 11 ELSE 1 END AS chg
FROM ev),
cells AS (SELECT layer, CAST(substr(layer, 4, 4) AS INTEGER) AS year, r, c, v
FROM (SELECT r, c, {", ".join(LAYERS)} FROM stack) UNPIVOT (v FOR layer IN ({", ".join(LAYERS)}))),
mask AS (SELECT r, c FROM stack WHERE c BETWEEN 3 AND 96),
region AS (SELECT c // 25 AS feat_id, r, c FROM stack WHERE lc_2001 IN (41, 42, 43))"""


def values_sql(name: str, columns: str, rows) -> str:
    def lit(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)

    body = ", ".join("(" + ", ".join(map(lit, row)) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


DETAILED = values_sql("detailed", "code, label", codes.DETAILED.items())
GENERAL = values_sql("general", "code, label", codes.GENERAL.items())


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([GRID, *ctes]) + "\n" + body


def remap_sql(v: str, table: dict, keep: bool = True) -> str:
    """A remap as a CASE ladder."""
    arms = " ".join(f"WHEN {a} THEN {'NULL' if b is None else b}" for a, b in table.items())
    return f"CAST(CASE {v} {arms} ELSE {v if keep else 'NULL'} END AS INTEGER)"


def in_sql(values) -> str:
    return "(" + ", ".join(map(str, values)) + ")"
