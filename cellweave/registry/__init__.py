"""All queries with their oracles."""

from cellweave.registry import (  # noqa: F401
    changes,
    neighbourhoods,
    projections,
    region_queries,
    scans,
    tables,
)
from cellweave.registry.base import ORACLES, QUERIES  # noqa: F401
