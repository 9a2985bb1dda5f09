import datetime as dt
import decimal
import random
import time

import pytest
from pyspark.sql import functions as F

from brindle.functions import times
from brindle.operators.asof import asof_join
from brindle.operators.ranges import range_join
from brindle.operators.rollups import coarser, fill_gaps, rollup
from brindle.sources.tables import scratch, stored
from brindle.streaming import windows

T0 = dt.datetime(2024, 1, 1)
AT = "k string, at timestamp_ntz, v int"


def _moments(seed, n, hot=0.5):
    draw = random.Random(seed)
    keys = [None, "a", "b", "c"]
    return [(("a" if draw.random() < hot else draw.choice(keys)), None if draw.random() < 0.05 else T0 + dt.timedelta(minutes=draw.randrange(600)), draw.randrange(5)) for _ in range(n)]


def test_times_in_any_zone(spark):
    moments = [T0, dt.datetime(2024, 3, 10, 2, 30, 0, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999), None]
    zero, day = dt.datetime(1970, 1, 1), dt.timedelta(days=1)
    df = spark.createDataFrame([(i, m) for i, m in enumerate(moments)], "i int, at timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 2024-03-10 02:30 is no time there
    try:
        at = times.micros("at")
        got = df.orderBy("i").select(at, times.bucket(at, times.DAY), times.shown(times.bucket(at, times.HOUR), times.HOUR, 13)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    want = [((m - zero) // dt.timedelta(microseconds=1), (m - zero) // day, m.isoformat(" ")[:13]) if m else (None,) * 3 for m in moments]
    assert list(map(tuple, got)) == want


@pytest.mark.parametrize("width", [times.MINUTE, times.HOUR, 400 * times.DAY])
def test_asof_join(spark, width):
    left, right = _moments(1, 80), _moments(2, 120)
    left += left[:5]
    got = asof_join(spark.createDataFrame(left, AT.replace("v", "x")), spark.createDataFrame(right, AT), ["k"], "at", "at", ["v"], width)
    assert got.columns == ["k", "at", "x", "v"]

    def best(k, at):
        seen = [(a, v) for r, a, v in right if k is not None and r == k and at is not None and a is not None and a <= at]
        return max(seen)[1] if seen else None

    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((*r, best(r[0], r[1])) for r in left), key=key)


def test_asof_join_empty(spark):
    some, none = spark.createDataFrame(_moments(3, 5), AT.replace("v", "x")), spark.createDataFrame([], AT)
    assert {r["v"] for r in asof_join(some, none, ["k"], "at", "at", ["v"]).collect()} == {None}
    assert asof_join(none.drop("v"), none, ["k"], "at", "at", ["v"]).count() == 0


def test_range_join(spark):
    draw = random.Random(4)
    points = [(i, None if i % 17 == 0 else draw.randrange(-500, 500)) for i in range(150)]
    spans = [(i, (s := draw.randrange(-600, 600)), s + draw.choice([-3, 0, 1, 2, 5, 64, 65, 900])) for i in range(80)] + [(99, None, 5), (98, 5, None)]
    got = range_join(spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(spans, "s long, since long, until long"), "at", "since", "until")
    want = [(p, s) for p, at in points for s, a, b in spans if None not in (at, a, b) and a <= at < b]
    assert sorted(map(tuple, got.select("p", "s").collect())) == sorted(want)
    wide = spark.createDataFrame([(1, 2**50 - 1, 2**51 + 1), (2, -(2**55) - 2, 2**55)], "s long, since long, until long")  # lengths next to powers of two
    ends = [2**50 - 2, 2**50 - 1, 2**50, 2**51 - 1, 2**51, 2**51 + 1, -(2**55) - 3, -(2**55) - 2, -(2**55), 0, 2**55 - 1, 2**55]
    got = range_join(spark.createDataFrame([(x,) for x in ends], "at long"), wide, "at", "since", "until")
    assert sorted(map(tuple, got.select("at", "s").collect())) == sorted((x, s) for x in ends for s, a, b in ((1, 2**50 - 1, 2**51 + 1), (2, -(2**55) - 2, 2**55)) if a <= x < b)
    assert range_join(spark.createDataFrame(points, "p long, at long"), spark.createDataFrame([], "s long, since long, until long"), "at", "since", "until").count() == 0


def test_rollup(spark):
    rows = _moments(5, 200)
    df = spark.createDataFrame(rows, AT)
    first, rest = df.filter("v < 2"), df.filter("v >= 2")
    parts = [rollup(x, ["k"], "at", "v", times.HOUR) for x in (first, rest)]
    merged = coarser(parts[0].union(parts[1]), ["k"])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, merged.collect()), key=key) == sorted(map(tuple, rollup(df, ["k"], "at", "v", times.HOUR).collect()), key=key)
    assert sorted(map(tuple, coarser(merged, ["k"], 24).collect()), key=key) == sorted(map(tuple, rollup(df, ["k"], "at", "v", times.DAY).collect()), key=key)
    thin = rollup(df.filter("k = 'c'"), ["k"], "at", "v", times.MINUTE)
    full = {r["bucket"]: r["n"] for r in fill_gaps(thin, ["k"]).collect()}
    known = {r["bucket"]: r["n"] for r in thin.collect()}
    assert full == {b: known.get(b, 0) for b in range(min(known), max(known) + 1)}
    assert rollup(df.limit(0), ["k"], "at", "v", times.HOUR).count() == 0


def test_rollup_sums_and_stray_times(spark):
    df = spark.createDataFrame([("a", T0, 0.125), ("a", T0, 0.004), ("a", dt.datetime(2034, 1, 1), 1.0)], "k string, at timestamp_ntz, v double")
    exact = rollup(df, ["k"], "at", "v", times.HOUR)
    assert sorted(r["total"] for r in exact.collect()) == [0.129, 1.0]
    assert sorted(r["total"] for r in rollup(df, ["k"], "at", "v", times.HOUR, 2).collect()) == [decimal.Decimal("0.13"), 1]
    full = fill_gaps(exact, ["k"])
    hours = int((dt.datetime(2034, 1, 1) - T0).total_seconds()) // 3600 + 1
    assert full.agg(F.count("*"), F.countDistinct("bucket"), F.sum("n")).first() == (hours, hours, 3)


@pytest.mark.parametrize("form", ["parquet", "orc", "json", "csv"])
def test_stored(spark, form):
    df = spark.createDataFrame([(1, "x, \"y\"\n", "a"), (2, None, "a"), (3, "", "b"), (4, "ж", None)], "i int, t string, p string")
    back = stored(df, scratch(spark, form), form, ["p"])
    assert sorted(map(tuple, back.select("i", "t", "p").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_late_rows_of_a_stream(spark):
    path = scratch(spark, "late")
    minute = lambda *m: spark.createDataFrame([(T0 + dt.timedelta(minutes=x),) for x in m], "at timestamp_ntz").coalesce(1)
    for part in (minute(1, 2, 65), minute(50, 190), minute(191), minute(3, 70), minute(400)):  # 50 is late and counts; 3 and 70 come too late
        part.write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in order of their times
    stream = spark.readStream.schema("at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(path).withColumn("k", F.lit("x"))
    told = windows.drained(windows.window_counts(stream, "at", ["k"], "1 hour", "30 minutes"), "told")
    assert sorted((r["window_start"].hour, r["n"]) for r in told.collect()) == [(0, 3), (1, 1), (3, 2)]
