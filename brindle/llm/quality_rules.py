"""Quality rules with adaptive thresholds.

Each document gets integer measures of its whole text.  Documents that pass the
base rule feed quantile sketches, one per (lang, source, measure): counts in
log-linear bins, which hold ``BITS`` leading bits of a value, so that a quantile
is off by less than 1/64 of itself at any size of value.  Such sketches merge by
addition, in any order and with the same result, so map-side partial sums do most
of the work and reruns agree.  The sketches of a language and of the whole corpus
are merged from those of its sources.

No cutoff is fixed: a fence stands ``REACH`` spreads from the median of its
language and source.  The spread is the wider half of the middle half (between
the quartiles), of the source or, if wider, of its language, so junk in the tails
moves neither.  Where both are nil, as for things that most texts lack, one event
in a text of the lower quartile's size is the spread: a source of long texts gets
a closer fence than one of short texts.  All of it is DataFrame expressions.

Cases: a null or empty text has no words and fails the base rule.  Null lang or
source is a group of its own.  Quartiles of fewer than ``min_support`` documents
say little: such a group uses the merged sketch of its language, then the one of
the corpus.  Repeated
rows count as often as they stand and all get the same verdict.  Columns of the
input that clash with the added ones, or begin with ``q_``, are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD, materialise, small

#: measure -> what its size is counted in, and what one event adds to its count (a repeated window has two times three words).
MEASURES = {"q_symbols": ("word_chars", 1), "q_dup_lines": ("q_n_lines", 1), "q_repeat_words": ("n_words", 6), "q_word_length": (None, 0)}
TWO_SIDED = ("q_word_length",)
REACH = 16
BITS = 7
#: Rates are in millionths, the mean word length is in thousandths of a character.
RATE = 1_000_000
#: Columns that the operator adds.
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def measures(docs: DataFrame, text: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """The carried columns (all by default), base measures and grid measures of each document, without a shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("q_text", t)
    df = df.withColumn("q_words", F.regexp_extract_all("q_text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("n_words", F.size("q_words").cast("long"))
    df = df.withColumn(
        "q_windows",
        F.expr("CASE WHEN n_words < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, cast(n_words AS int) - 3), i -> xxhash64(get(q_words, i), get(q_words, i + 1), get(q_words, i + 2))) END"),
    )
    # Positions are looked at only where some window occurs twice.
    df = df.withColumn(
        "q_sorted",
        F.expr("CASE WHEN size(array_distinct(q_windows)) < size(q_windows) THEN sort_array(transform(q_windows, (h, i) -> struct(h, i))) END"),
    )
    df = df.withColumn(
        "q_places",
        F.expr("sort_array(transform(filter(transform(q_sorted, (e, i) -> struct(e.i AS p, coalesce(e.h = get(q_sorted, i - 1).h, false) OR coalesce(e.h = get(q_sorted, i + 1).h, false) AS twice)), e -> e.twice), e -> e.p))"),
    )
    df = df.withColumn("q_lines", F.filter(F.split("q_text", "\n"), lambda x: x.rlike(WORD)))
    df = df.select(
        *[c for c in (carry or docs.columns) if not c.startswith("q_") and c not in OWN],
        "n_words",
        F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("q_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("coalesce(aggregate(transform(q_places, (p, j) -> least(3, coalesce(get(q_places, j + 1) - p, 3))), 0L, (a, x) -> a + x), 0L)").alias("n_repeat_words"),
        F.size("q_lines").cast("long").alias("q_n_lines"),
    )
    rates = {
        "q_symbols": f"{RATE} * n_symbols div greatest(word_chars, 1)",
        "q_dup_lines": f"{RATE} * n_dup_lines div greatest(q_n_lines, 1)",
        "q_repeat_words": f"{RATE} * n_repeat_words div greatest(n_words, 1)",
        "q_word_length": "1000 * word_chars div greatest(n_words, 1)",
    }
    return df.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")).withColumns({k: F.expr(v) for k, v in rates.items()})


def sketches(measured: DataFrame) -> DataFrame:
    """The sketch of each (lang, source, measure), and of the size that a measure is relative to: rows (lang, source, measure, bin, n).

    A bin is named by its least value: the ``BITS`` leading bits, then zeros.
    """
    values = {m: m for m in MEASURES} | {f"{m}_size": size for m, (size, _) in MEASURES.items() if size}
    pairs = ", ".join(f"'{name}', {c}" for name, c in values.items())
    rest = f"greatest(length(bin(v)) - {BITS}, 0)"
    return (
        measured.filter(~F.col("base_failed"))
        .select("lang", "source", F.expr(f"stack({len(values)}, {pairs}) AS (measure, v)"))
        .groupBy("lang", "source", "measure", F.expr(f"shiftleft(shiftright(v, {rest}), {rest})").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


_QUARTILES = ("low", "mid", "high")


def _quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, low_m, mid_m, high_m for each measure m, least_m: the lower quartile of its size) of each merged sketch."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")  # as many rows as a sketch has bins
    below = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    counted = merged.select(*keys, "measure", "bin", below.alias("below"), F.sum("n").over(w).alias("total"))
    at = lambda name, k: F.min(F.when((F.col("measure") == name) & (F.col("below") * 4 >= F.col("total") * k), F.col("bin")))
    out = [F.max("total").alias("total")]
    for m, (size, _) in MEASURES.items():
        out += [at(m, k).alias(f"{q}_{m}") for k, q in enumerate(_QUARTILES, 1)]
        out.append((at(f"{m}_size", 1) if size else F.lit(0).cast("long")).alias(f"least_{m}"))
    return counted.groupBy(*keys).agg(*out)


def thresholds(sketch: DataFrame, min_support: int = 20) -> DataFrame:
    """One row per (lang, source) with a fence for each measure; ``sketch`` is read several times."""
    groups, langs = _quantiles(sketch, "lang", "source"), _quantiles(sketch, "lang")
    corpus = _quantiles(sketch).first().asDict()  # one row
    values = [c for c in groups.columns if c not in ("lang", "source")]
    named = lambda df, k: df.select(*[F.col(c).alias(f"{k}_{c}" if k else c) for c in df.columns])
    both = named(groups, "g").join(named(langs, "l"), F.col("g_lang").eqNullSafe(F.col("l_lang")))
    chosen = lambda c, *levels: F.coalesce(*[F.when(F.col(f"{k}_total") >= min_support, F.col(f"{k}_{c}")) for k in levels], F.lit(corpus[c]).cast("long"))
    both = both.select(
        F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), *[chosen(c, "g", "l").alias(c) for c in values], *[chosen(c, "l").alias(f"up_{c}") for c in values]
    )
    out = [F.col("lang"), F.col("source")]
    for m, (size, event) in MEASURES.items():
        halves = [F.col(f"{up}{b}_{m}") - F.col(f"{up}{a}_{m}") for up in ("", "up_") for a, b in (("low", "mid"), ("mid", "high"))]
        one = [F.expr(f"{event * RATE} div greatest(least_{m}, 1)")] if size else []
        reach = F.greatest(*halves, *one) * REACH
        out.append((F.col(f"mid_{m}") + reach).alias(f"{m}_most"))
        if m in TWO_SIDED:
            out.append((F.col(f"mid_{m}") - reach).alias(f"{m}_least"))
    return both.select(*out)


def quality_rules(docs: DataFrame, text: str = "text", min_support: int = 20, carry: tuple[str, ...] | None = None) -> DataFrame:
    """The carried columns of ``docs`` (all by default; lang and source must be among them), the measures, ``base_failed`` and ``kept``.

    The measured documents are written once; sketches and verdicts read that.
    """
    measured = materialise(measures(docs, text, carry), "measured")
    fence = materialise(thresholds(materialise(sketches(measured), "sketches"), min_support), "fences")
    f = small(fence).select(F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), *[c for c in fence.columns if c not in ("lang", "source")])
    joined = measured.join(f, measured["lang"].eqNullSafe(f["q_lang"]) & measured["source"].eqNullSafe(f["q_source"]), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & (F.col(m) <= F.col(f"{m}_most"))
        if m in TWO_SIDED:
            inside = inside & (F.col(m) >= F.col(f"{m}_least"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select(*measured.columns, kept.alias("kept")).drop("q_n_lines")
