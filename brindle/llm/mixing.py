"""Mixing sources to target weights by weighted sampling without replacement.

Each source gets a target of words (weights, filled up like water below each
source's cap).  Complete epochs of a source come first; the rest of its target
is filled by Efraimidis-Spirakis sampling: each document draws the exponential
key -ln(u) / quality, and documents are taken in order of their keys until the
word budget is used.  No source is ever sorted in one task: keys are fixed-point
numbers, read digit by digit.  The totals of a digit's bins are prefix-summed per
source, bins below the one in which the budget ends are taken whole, and only that
bin is split again by the next digit, until no source has more than ``SORTED``
rows left in it; those are put in order.  Targets, too, come from prefix sums over
ranges of sources, so there may be any number of them.  All of it is DataFrame
expressions.

Cases: a null text has size 0.  A null source is a source of its own, the last
in order.  Repeated rows are separate documents with the same key; they follow in
an order of their own, and as they are alike, it does not matter which of them is
taken.  A null doc_id draws by its text.  An empty table gives an empty result.
u comes from a hash of doc_id and seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD, materialise, small

#: Rows of a source that may be put in order in one task.
SORTED = 50_000
#: Keys are read in 2**-52; then the digits of what parts equal keys follow: more of the hash, and a number of the row.
_UNIT = float(2**52)
_DIGITS = [("k1", 44), *(("k1", s) for s in (32, 20, 8, 0)), *(("k2", s) for s in (40, 28, 16, 4, 0)), *(("k3", s) for s in (48, 36, 24, 12, 0))]


def text_quality(text: str = "text") -> Column:
    """A quality weight in [0.1, 1]: less for texts that are full of symbols."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    symbols = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[#*$%&|<>]"))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(4.0) * symbols / F.greatest(n, F.lit(1)))


def _prefix_sums(df: DataFrame, order: list[Column], sums: list[str], label: str) -> DataFrame:
    """``df`` with ``place`` (from 0) and, for each column of ``sums``, ``c_before``: its sum over the rows before; no task has all rows."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialise(df.repartitionByRange(n, *order).withColumn("m_part", F.spark_partition_id()), label)
    totals = dealt.groupBy("m_part").agg(F.count("*").alias("n_p"), *[F.sum(c).alias(f"{c}_p") for c in sums])
    earlier = Window.orderBy("m_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = totals.select(F.col("m_part").alias("p"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("n_p", *[f"{c}_p" for c in sums])])
    within = Window.partitionBy("m_part").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    df_ = dealt.withColumn("place", F.row_number().over(within) - 1).withColumns({f"{c}_before": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums})
    df_ = df_.join(F.broadcast(totals), F.col("m_part") == F.col("p"))  # a row per partition
    return df_.withColumns({"place": F.col("place") + F.col("n_p")} | {f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_p") for c in sums}).select(*df.columns, "place", *[f"{c}_before" for c in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share_percent: int = 150, cap: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    In order of cap / weight, a prefix of the sources is at its cap; the rest
    divide what is left by weight.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = [F.col("source").isNull().asc(), F.col("source").asc()]
    df = _prefix_sums(sizes, by_name, [], "sources")
    df = df.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * cap).drop("place")
    df = _prefix_sums(df, [(F.col("most") / F.col("weight")).asc(), *by_name], ["most", "weight"], "filled")
    df = materialise(df, "filled_sums")
    size, weight = df.agg(F.sum("source_size"), F.sum("weight")).first()  # two numbers
    level = (F.lit((size or 0) * share_percent / 100.0) - F.col("most_before")) / (F.lit(weight or 0) - F.col("weight_before"))
    df = df.withColumn("level", level)
    # The first source that is not filled to its cap sets the level for itself and all after it.
    at = df.filter(F.col("level") * F.col("weight") <= F.col("most")).agg(F.min(F.struct("place", "level"))["level"]).first()[0]
    full = F.col("most").cast("double")
    target = full if at is None else F.least(full, F.lit(at) * F.col("weight"))
    return df.select("source", "source_size", target.alias("target"))


def _null_safe(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on source, null matching null; columns of b other than source are added."""
    b = b.withColumnRenamed("source", "m_source")
    return a.join(b, a["source"].eqNullSafe(b["m_source"]), how).drop("m_source")


def _digit(k: int) -> Column:
    name, shift = _DIGITS[k]
    above = [s for n, s in _DIGITS[:k] if n == name]
    digit = F.shiftright(name, shift)
    return digit if not above else digit % (1 << (above[-1] - shift))


def _end(df: DataFrame, k: int, budgets: DataFrame) -> DataFrame:
    """For each source the bin of digit k in which its budget ends, the words before that bin and the rows in it."""
    sums = df.withColumn("bin", _digit(k)).groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # a row per bin
    run = _null_safe(sums.select("source", "bin", "rows", upto.alias("upto"), (upto - F.col("words")).alias("before")), budgets, "inner")
    ends = run.filter(F.col("upto") >= F.col("budget")).groupBy("source").agg(F.min(F.struct("bin", "before", "rows", "budget")).alias("x"))
    return ends.select("source", F.col("x.bin").alias("bin"), F.col("x.rows").alias("rows"), (F.col("x.budget") - F.col("x.before")).alias("budget"))


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    quality: Column | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    share_percent: int = 150,
    cap: int = 2,
    seed: int = 17,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, key, taken) of every document.

    ``taken`` is size times the complete epochs, and once more if the document
    is drawn for the fraction.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.xxhash64(text).cast("string")))
    digest = F.md5(F.concat_ws(":", name, F.lit(str(seed))))
    part = lambda begin: F.conv(F.substring(digest, begin, 13), 16, 10).cast("long")
    u = (part(1) + F.lit(0.5)) / F.lit(float(2**52))
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    drawn = docs.select("doc_id", "source", size.alias("size"), u.alias("u"), part(14).alias("k2"), (quality if quality is not None else text_quality(text)).alias("quality"))
    drawn = drawn.withColumn("key", -F.log("u") / F.col("quality")).withColumn("k1", F.floor(F.col("key") * _UNIT).cast("long"))
    drawn = drawn.withColumn("k3", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4))
    drawn = materialise(drawn.drop("u", "quality"), "drawn")

    plan = targets(drawn.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share_percent, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialise(plan, "targets")
    ends, budgets, rest = plan, small(plan.select("source", "budget")), drawn
    inside, at_end = F.lit(False), F.lit(True)
    for k in range(len(_DIGITS)):
        end = materialise(_end(rest, k, budgets), "bins")
        ends = _null_safe(ends.drop("budget"), end.select("source", F.col("bin").alias(f"bin{k}"), "budget"), "left")
        inside, at_end = inside | (at_end & (_digit(k) < F.col(f"bin{k}"))), at_end & (_digit(k) == F.col(f"bin{k}"))
        if not end.filter(F.col("rows") > SORTED).limit(1).count():
            break
        rest = _null_safe(rest, small(end.select("source", "bin")), "inner").filter(_digit(k) == F.col("bin")).drop("bin")
        budgets = small(end.select("source", "budget"))
    ends = materialise(ends, "ends")

    df = _null_safe(drawn, small(ends), "left")
    # Only the last narrow bin of each source is put in order.
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("k1", "k2", "k3").rowsBetween(Window.unboundedPreceding, 0))
    nearer = (F.col("upto") - F.col("budget")) <= (F.col("budget") - (F.col("upto") - F.col("size")))
    columns = ["doc_id", "source", "size", "source_size", "target", "epochs", "key"]
    last = F.coalesce(at_end, F.lit(False))
    tail = df.filter(last).withColumn("upto", upto).withColumn("drawn", F.coalesce(nearer, F.lit(False)))
    whole = df.filter(~last).withColumn("drawn", F.coalesce(inside, F.lit(False)))
    both = whole.select(*columns, "drawn").unionByName(tail.select(*columns, "drawn"))
    return both.select(*columns, (F.col("size") * F.col("epochs") + F.when(F.col("drawn"), F.col("size")).otherwise(F.lit(0))).cast("long").alias("taken"))
