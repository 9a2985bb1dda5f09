"""Range join: points to the half-open intervals that hold them, as an equi-join.

An interval stands in at most two cells of the grid whose cells are as long as
the interval, rounded up to a power of two; a point stands in one cell of each
grid in use (63 at most).  So neither long intervals nor short ones multiply
rows, and a crowded stretch of time is split among its cells.

Cases: intervals with a null end, or no length, hold nothing; null points are in
no interval.  Repeated rows join as often as they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: list[str] | None = None) -> DataFrame:
    """All columns of both sides (``by`` once) where start <= at < end; the three columns are whole numbers."""
    by = by or []
    length = F.col(end) - F.col(start)
    usable = intervals.filter(length > 0).withColumn("r_grid", F.length(F.bin(length - 1)))  # binary digits: 2 ** r_grid >= length
    cell = lambda c: F.expr(f"shiftright({c}, r_grid)")
    placed = usable.withColumn("r_cell", F.explode(F.array_distinct(F.array(cell(f"cast({start} AS long)"), cell(f"cast({end} - 1 AS long)")))))
    grids = sorted(r[0] for r in usable.select("r_grid").distinct().collect())  # at most 63
    spread = points.filter(F.col(at).isNotNull()).withColumn("r_grid", F.explode(F.array(*[F.lit(g) for g in grids]).cast("array<int>"))).withColumn("r_cell", cell(f"cast({at} AS long)"))
    joined = spread.join(placed, [*by, "r_grid", "r_cell"])
    return joined.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("r_grid", "r_cell")
