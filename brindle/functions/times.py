"""Time as whole microseconds, free of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(name: str) -> Column:
    """Microseconds since 1970-01-01 00:00 of a timestamp column, by its own clock."""
    since = f"(cast(`{name}` AS timestamp_ntz) - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    parts = [f"cast(extract({unit} FROM {since}) * {size} AS bigint)" for unit, size in (("DAY", f"{DAY}L"), ("HOUR", f"{HOUR}L"), ("MINUTE", f"{MINUTE}L"), ("SECOND", "1000000L"))]
    return F.expr(" + ".join(parts))


def bucket(at: Column, width: int) -> Column:
    """The number of the bucket of ``width`` microseconds that holds ``at``."""
    return F.call_function("div", at - F.pmod(at, F.lit(width).cast("long")), F.lit(width).cast("long"))


def shown(number: Column, width: int, n_chars: int) -> Column:
    """The first characters of a bucket's start: 10 for the day, 13 for the hour."""
    start = F.timestamp_add("MICROSECOND", number * F.lit(width).cast("long"), F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.substring(start.cast("string"), 1, n_chars)
