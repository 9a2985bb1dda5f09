"""Time rollups that are kept as mergeable partial results.

A rollup has one row per key and time bucket: count, sum, least and most.  It can
be stored, merged with the rollup of later data, and made coarser without the
rows behind it.

Sums are those of the value's own type: exact for whole numbers and decimals, while
those of floating numbers depend on the order in their last digits.  With ``scale``,
values are summed as decimals of so many places instead: in any order the same, and
exact where values have no more places.

Cases: rows with a null time are left out; null values count as rows but add
nothing; a null key is a key of its own.  An empty table gives an empty rollup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import bucket as group
from ..functions.times import micros


def rollup(df: DataFrame, keys: list[str], at: str, value: str, width: int, scale: int | None = None) -> DataFrame:
    """(keys, bucket, n, total, least, most) by buckets of ``width`` microseconds."""
    added = F.col("r_value") if scale is None else F.col("r_value").cast(f"decimal(28,{scale})")
    rows = df.filter(F.col(at).isNotNull()).select(*keys, group(micros(at), width).alias("bucket"), F.col(value).alias("r_value"))
    return rows.groupBy(*keys, "bucket").agg(
        F.count("*").alias("n"),
        F.sum(added).alias("total"),
        F.min("r_value").alias("least"),
        F.max("r_value").alias("most"),
    )


def coarser(partial: DataFrame, keys: list[str], times: int = 1) -> DataFrame:
    """Merge partial rows; ``times`` fine buckets make a coarse one."""
    number = group(F.col("bucket"), times).alias("bucket")
    return partial.groupBy(*keys, number).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


#: Buckets that one array of a filled gap holds at most.
_FILLED = 10_000


def fill_gaps(partial: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, n) with a row, n = 0, for each bucket that a key lacks between its first and its last.

    Only gaps are filled, in blocks of bounded size, so a stray time far off costs
    its rows but no huge array.
    """
    known = partial.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    following = F.lead("bucket").over(Window.partitionBy(*keys).orderBy("bucket"))  # a row per key and bucket
    gaps = known.select(*keys, (F.col("bucket") + 1).alias("r_first"), (following - 1).alias("r_last")).filter("r_first <= r_last")
    blocks = gaps.select(*keys, "r_last", F.explode(F.expr(f"sequence(r_first, r_last, {_FILLED * _FILLED}L)")).alias("r_first"))
    blocks = blocks.select(*keys, "r_last", F.explode(F.expr(f"sequence(r_first, least(r_first + {_FILLED * _FILLED - 1}L, r_last), {_FILLED}L)")).alias("r_first"))
    every = blocks.select(*keys, F.explode(F.expr(f"sequence(r_first, least(r_first + {_FILLED - 1}L, r_last))")).alias("bucket"), F.lit(0).cast("long").alias("n"))
    return known.unionByName(every)
