"""Data model: a grid is a table of cells, features are cell sets held as runs.

cells    ``r, c`` and ``v`` (null is NoData inside the extent; an absent row is
         outside it); ``layer`` and ``year`` where several grids share a table
stack    one row per cell with a column per layer: co-registered grids joined
         once, so that overlays are projections and need no further shuffle
runs     ``r, c0, c1`` maximal horizontal runs of a cell set, with key columns
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

CELLS = T.StructType(
    [
        T.StructField("layer", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("r", T.LongType()),
        T.StructField("c", T.LongType()),
        T.StructField("v", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class GridSpec:
    """Origin, cell size, shape and coordinate-system tag of a grid."""

    x0: float = 0.0
    y0: float = 0.0
    size: float = 30.0
    crs: str = "local"
    nrows: int | None = None
    ncols: int | None = None
    north_up: bool = False

    def x(self, c):
        """The centre of a column."""
        return self.x0 + (c + 0.5) * self.size

    def y(self, r):
        """The centre of a row; ``y0`` is the upper edge of a north-up grid, else the lower one."""
        return self.y0 - (r + 0.5) * self.size if self.north_up else self.y0 + (r + 0.5) * self.size

    def row(self, y):
        """Rows from the grid's edge to a coordinate, with fractions."""
        return (self.y0 - y) / self.size if self.north_up else (y - self.y0) / self.size

    def inside(self, r, c):
        """Whether a cell lies in the grid's shape, as far as that is given."""
        ok = (r >= 0) & (c >= 0)
        ok = ok if self.nrows is None else ok & (r < self.nrows)
        return ok if self.ncols is None else ok & (c < self.ncols)
