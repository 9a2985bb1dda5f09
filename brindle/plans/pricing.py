"""Order-pricing reports over the star schema, as declarative plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and means per return flag and line status: one scan, partial sums, a tiny shuffle."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")  # exact sums in any order
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
        F.sum(price).cast("double").alias("sum_disc_price"),
        F.count("*").alias("n_lines"),
    )


PRICING_SUMMARY_SQL = """
SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS sum_qty,
       sum((l_extendedprice * (1 - l_discount))::DECIMAL(18, 4))::DOUBLE AS sum_disc_price, count(*) AS n_lines
FROM lineitem GROUP BY l_returnflag, l_linestatus
"""
