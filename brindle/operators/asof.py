"""As-of join: to each row of the left side the latest row of the right side that isn't later.

Both sides go through one shuffle by key and time bucket, so a key with a third
of all rows is spread over its buckets.  Within a bucket a window finds the latest
value; a row that has none in its own bucket takes the last value of an earlier
bucket, from a table with one row per key and bucket.

Cases: a null key or time matches nothing, and the left row stays with nulls.
Right rows of one time: the greatest values in column order win.  Repeated left
rows stay.  A left column named like a value column is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import HOUR, bucket, micros


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], width: int = HOUR) -> DataFrame:
    """The columns of ``left`` and the right side's ``values``; ``width`` is the bucket in microseconds."""
    keys = [f"a_by{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    known = right.filter(F.col(right_at).isNotNull()).dropna(subset=by)
    r = known.select(*named, micros(right_at).alias("a_at"), F.struct(*values).alias("a_value"))
    l = left.select(*named, micros(left_at).alias("a_at"), F.struct(*left.columns).alias("a_row"))  # noqa: E741
    both = r.unionByName(l, allowMissingColumns=True).withColumn("a_bucket", bucket(F.col("a_at"), width))

    last = F.max(F.when(F.col("a_value").isNotNull(), F.struct("a_at", "a_value"))).alias("a_top")
    earlier = Window.partitionBy(*keys).orderBy("a_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    carried = both.groupBy(*keys, "a_bucket").agg(last).select(*keys, "a_bucket", F.last("a_top", ignorenulls=True).over(earlier)["a_value"].alias("a_before"))

    upto = Window.partitionBy(*keys, "a_bucket").orderBy("a_at", F.col("a_row").isNotNull(), "a_value").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("a_here", F.last("a_value", ignorenulls=True).over(upto)).filter(F.col("a_row").isNotNull())
    found = F.coalesce("a_here", "a_before")
    kept = [F.col("a_row")[c].alias(c) for c in left.columns if c not in values]
    return inside.join(carried, [*keys, "a_bucket"], "left").select(*kept, *[found[c].alias(c) for c in values])
