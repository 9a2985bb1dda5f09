"""Line dedup by the spread of a line over distinct sites.

A line that stands on many sites is boilerplate.  Lines are known by a 128-bit
hash.  Lines that occur at least ``min_sites`` times (a partial count) get a
HyperLogLog sketch of their sites, merged by aggregation.  Where the estimate
lies within ``margin`` of the threshold, the exact number of distinct sites
decides.  Boilerplate lines are removed from all documents; the rest of each text
stays as it is.

Cases: a null text has no lines and stays null.  Lines are compared without
white space at their ends; lines of fewer than ``min_words`` words always stay.
A null site counts as one site.  Repeated rows are handled alike (they are known
by doc_id and a hash of the text).  A null doc_id is an id like others.  An
empty table gives an empty result.  Columns named ``n_lines`` or ``n_removed``
are replaced; others may have any name.  Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, aside, materialise, small


def _lines(docs: DataFrame, text: str, site: str, min_words: int) -> DataFrame:
    """(doc_id, version, place, h1, h2, site) of each line that can be boilerplate."""
    base = docs.filter(F.col(text).isNotNull()).select("doc_id", F.xxhash64(text).alias("version"), F.coalesce(F.concat(F.lit("s"), F.col(site)), F.lit("")).alias("site"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    line = base.withColumn("line", F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")).filter(F.regexp_count("line", F.lit(WORD)) >= min_words)
    return line.select("doc_id", "version", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "site")


def boilerplate(lines: DataFrame, min_sites: int, margin: float = 0.25) -> DataFrame:
    """(h1, h2, sites) of lines on at least ``min_sites`` sites."""
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("h1", "h2")
    often = materialise(often, "often")
    seen = lines.select("h1", "h2", "site").join(small(often), ["h1", "h2"])
    spread = seen.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(12))).alias("sites"))
    spread = materialise(spread, "spread")
    near = (F.col("sites") >= min_sites * (1 - margin)) & (F.col("sites") <= min_sites * (1 + margin))
    unsure = spread.filter(near).select("h1", "h2")
    exact = seen.join(small(unsure), ["h1", "h2"]).select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    return spread.filter(~near & (F.col("sites") >= min_sites)).unionByName(exact.filter(F.col("sites") >= min_sites))


def line_dedup(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 6, min_words: int = 3) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, and n_lines and n_removed of each document."""
    names = {f"aside_{k}" if c not in ("doc_id", text, site) else c: c for k, c in enumerate(docs.columns)}
    docs = aside(docs, ("doc_id", text, site))
    lines = materialise(_lines(docs, text, site, min_words), "lines")
    common = materialise(boilerplate(lines, min_sites), "boilerplate")
    found = lines.join(small(common.select("h1", "h2")), ["h1", "h2"])
    places = found.groupBy(F.col("doc_id").alias("l_id"), F.col("version").alias("l_version")).agg(F.sort_array(F.collect_set("place")).alias("l_places"))
    places = materialise(places, "places").hint("merge")  # one way at every size
    version = F.xxhash64(text)
    marked = docs.withColumn("l_own", version).join(places, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("l_own") == F.col("l_version")), "left")
    marked = marked.withColumn("l_lines", F.split(text, "\n"))
    # Between two removed places lies a run of lines that stays.
    before = "coalesce(get(l_places, j - 1), -1)"
    kept = F.expr(f"flatten(transform(array_append(l_places, size(l_lines)), (q, j) -> slice(l_lines, {before} + 2, q - {before} - 1)))")
    columns = [F.col(x).alias(c) for x, c in names.items() if c not in ("n_lines", "n_removed", text)]
    return marked.select(
        *columns,
        F.when(F.col("l_places").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("l_lines")).cast("long").alias("n_lines"),
        F.when(F.col("l_places").isNull(), F.lit(0)).otherwise(F.size("l_places")).cast("long").alias("n_removed"),
    )
