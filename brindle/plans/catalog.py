"""General analytical queries over the star schema and the event table, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import times
from ..operators.asof import asof_join
from ..operators.ranges import range_join
from ..operators.rollups import coarser, fill_gaps, rollup
from ..sources.tables import scratch, stored
from ..sources.tables import table as _t
from ..streaming import windows
from . import pricing


def segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by market segment and order year: two joins on keys, filters and columns pushed to the scans.

    Prices are summed as decimals, so the order in which tasks end doesn't matter.
    """
    items = _t(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") != "R").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("price"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("order_year"))
    people = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", "order_year").agg(F.sum("price").cast("double").alias("revenue"), F.count("*").alias("n_lines"))


def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three customers with the most orders in each nation; ties by key.  Orders are summed before the rank."""
    spent = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    people = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")  # a row per nation
    ranked = spent.join(people, F.col("o_custkey") == F.col("c_custkey")).withColumn("place", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n_orders"), "c_custkey"))).filter("place <= 3")
    return ranked.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "place", "c_custkey", "n_orders")


def sessions(spark: SparkSession, sf_dir: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: a pause of more than half an hour begins a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    begun = F.coalesce((F.col("ts") > F.lag("ts").over(w) + F.expr(f"INTERVAL {gap}")).cast("int"), F.lit(1))
    numbered = events.withColumn("begun", begun).withColumn("session", F.sum("begun").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("event_id").alias("least_event"))


def event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and day with subtotals."""
    events = _t(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    return events.rollup("event_type", "day").agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"))


def unreturned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand that no line with a large return names, by an anti join."""
    parts = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    items = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 45").select("l_partkey")
    return parts.join(items, F.col("p_partkey") == F.col("l_partkey"), "left_anti").groupBy("p_brand").agg(F.count("*").alias("n_parts"))


def last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's latest view before it, by an as-of join."""
    events = _t(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return asof_join(bought, seen, ["user_id"], "ts", "ts", ["view_id", "view_value"]).select("event_id", "user_id", "view_id", "view_value")


def near_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the events of all users in the half hour from it on, by a range join."""
    events = _t(spark, sf_dir, "events").select("event_id", "event_type", times.micros("ts").alias("at"))
    spans = events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("at").alias("since"), (F.col("at") + 30 * times.MINUTE).alias("until"))
    return range_join(events.select("at"), spans, "at", "since", "until").groupBy("error_id").agg(F.count("*").alias("n_events"))


def daily_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by event type and day, merged from hourly partial results."""
    hourly = rollup(_t(spark, sf_dir, "events"), ["event_type"], "ts", "value", times.HOUR, 2)  # values are in hundredths
    daily = coarser(hourly, ["event_type"], 24)
    return daily.select("event_type", times.shown(F.col("bucket"), times.DAY, 10).alias("day"), "n", F.col("total").cast("double").alias("total"), "least", "most")


def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours between a type's first and last event in which it has none."""
    hourly = rollup(_t(spark, sf_dir, "events"), ["event_type"], "ts", "value", times.HOUR)
    return fill_gaps(hourly, ["event_type"]).filter("n = 0").select("event_type", times.shown(F.col("bucket"), times.HOUR, 13).alias("hour"))


def streamed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type from a stream; the windows that the watermark has closed."""
    events = spark.readStream.schema(_t(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern that no other name fits
    told = windows.drained(windows.window_counts(events, "ts", ["event_type"], "1 hour", "2 hours"), "hours")
    return told.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def stored_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation, read back from CSV in folders by region."""
    people = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n_customers"))
    nations = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = nations.join(people, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "n_customers", "n_regionkey")
    return stored(rows, scratch(spark, "nations"), "csv", ["n_regionkey"]).filter("n_regionkey >= 2").select("n_name", "n_customers", "n_regionkey")


QUERIES = {
    "pricing_summary": pricing.pricing_summary,
    "segment_revenue": segment_revenue,
    "top_customers": top_customers,
    "sessions": sessions,
    "event_rollup": event_rollup,
    "unreturned_parts": unreturned_parts,
    "last_view": last_view,
    "near_errors": near_errors,
    "daily_values": daily_values,
    "quiet_hours": quiet_hours,
    "streamed_hours": streamed_hours,
    "stored_nations": stored_nations,
}

SQL = {
    "pricing_summary": pricing.PRICING_SUMMARY_SQL,
    "segment_revenue": """
SELECT c_mktsegment, year(o_orderdate)::INTEGER AS order_year, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18, 4))::DOUBLE AS revenue, count(*) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag <> 'R' GROUP BY ALL""",
    "top_customers": """
SELECT n_name, place::INTEGER AS place, c_custkey, n_orders FROM (
  SELECT c_nationkey, c_custkey, n_orders, row_number() OVER (PARTITION BY c_nationkey ORDER BY n_orders DESC, c_custkey) AS place
  FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey) JOIN nation ON c_nationkey = n_nationkey
WHERE place <= 3""",
    "sessions": """
SELECT user_id, session::BIGINT AS session, count(*) AS n_events, min(event_id) AS least_event FROM (
  SELECT user_id, event_id, sum(begun) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT user_id, event_id, ts, coalesce((ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE)::INTEGER, 1) AS begun FROM events))
GROUP BY ALL""",
    "event_rollup": """
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY ROLLUP (event_type, strftime(ts, '%Y-%m-%d'))""",
    "unreturned_parts": """
SELECT p_brand, count(*) AS n_parts FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 45) GROUP BY p_brand""",
    "last_view": """
SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "near_errors": """
SELECT x.event_id AS error_id, count(*) AS n_events FROM events x JOIN events e ON e.ts >= x.ts AND e.ts < x.ts + INTERVAL 30 MINUTE WHERE x.event_type = 'error' GROUP BY x.event_id""",
    "daily_values": """
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(value::DECIMAL(18, 2))::DOUBLE AS total, min(value) AS least, max(value) AS most FROM events GROUP BY ALL""",
    "quiet_hours": """
WITH h AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS h FROM events),
a AS (SELECT event_type, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM h GROUP BY event_type)
SELECT event_type, strftime(h, '%Y-%m-%d %H') AS hour FROM a ANTI JOIN h USING (event_type, h)""",
    "streamed_hours": """
SELECT strftime(h, '%Y-%m-%d %H') AS hour, event_type, n FROM (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY ALL)
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
    "stored_nations": """
SELECT n_name, count(*) AS n_customers, n_regionkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_regionkey >= 2 GROUP BY n_name, n_regionkey""",
}
