"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, jaccard_join, license_scan, line_dedup, mixing, pii, quality_rules, suffix_dedup, token_files


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the registered query where the session has no ``spark.brindle.pii.key``; it is public, so it hides nothing.
SHOWN_KEY = "for the given tables only"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(_table(spark, sf_dir, "documents"), spark.conf.get("spark.brindle.pii.key", SHOWN_KEY))
    return found.select("doc_id", "text", "n_found", F.array_join("kinds", ",").alias("kinds"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    judged = quality_rules.quality_rules(docs, carry=("doc_id", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return token_files.read_tokens(spark, folder)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    return seen.select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join("families", ",").alias("families"), F.array_max(F.transform("found", lambda x: x["probability"])).alias("best_probability"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role")) for t, r in ((0, "user"), (1, "assistant"))])).alias("x")
    hard = spark.range(1).select(both).select(F.lit(-1).cast("long").alias("conv_id"), "x.turn", "x.role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = chat_format.format_chats(said.union(hard))
    df = chats.withColumn("turns", chat_format.parse(F.col("formatted"))).withColumn("masked", chat_format.masked_text())
    flat = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 400)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest().alias("items_sha256"), "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i:i+2] AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  [1000000 * n_symbols // greatest(word_chars, 1), 1000000 * n_dup_lines // greatest(n_lines, 1), 1000000 * n_repeat_words // greatest(n_words, 1), 1000 * word_chars // greatest(n_words, 1)] AS v,
  [word_chars, n_lines, n_words, 0] AS d FROM m),
u AS (SELECT lang, source, k, v[k] AS v, d[k] AS d FROM b, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE NOT base_failed),
q AS (SELECT k, GROUPING(lang) + GROUPING(source) AS up, lang, source, count(*) AS n,
  list_transform([quantile_disc(v, 0.25), quantile_disc(v, 0.5), quantile_disc(v, 0.75), quantile_disc(d, 0.25)], lambda x: CASE WHEN x < 128 THEN x ELSE (x >> (length(bin(x)) - 7)) << (length(bin(x)) - 7) END) AS q
  FROM u GROUP BY GROUPING SETS ((k, lang, source), (k, lang), (k))),
f AS (SELECT a.lang, a.source, a.k, CASE WHEN a.n >= 20 THEN a.q WHEN l.n >= 20 THEN l.q ELSE c.q END AS q, CASE WHEN l.n >= 20 THEN l.q ELSE c.q END AS p
  FROM q a JOIN q l ON a.up = 0 AND l.up = 1 AND a.k = l.k AND a.lang IS NOT DISTINCT FROM l.lang JOIN q c ON c.up = 2 AND c.k = a.k),
s AS (SELECT lang, source, k, q[2] AS mid, 16 * greatest(q[3] - q[2], q[2] - q[1], p[3] - p[2], p[2] - p[1], [1, 1, 6, 0][k] * 1000000 // greatest(q[4], 1)) AS reach FROM f),
x AS (SELECT doc_id, bool_and(v[s.k] <= mid + reach AND (s.k < 4 OR v[4] >= mid - reach)) AS inside FROM b JOIN s ON b.lang IS NOT DISTINCT FROM s.lang AND b.source IS NOT DISTINCT FROM s.source GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, true) AS kept FROM b LEFT JOIN x USING (doc_id)
"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
r AS (SELECT doc_id AS x, doc_id AS c FROM w UNION SELECT links.y, r.c FROM r JOIN links ON links.x = r.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.x = w.doc_id GROUP BY ALL
"""

_CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
m AS (SELECT *, CASE role WHEN 'system' THEN '[SYS]' WHEN 'user' THEN '[INST]' WHEN 'assistant' THEN '<s>' ELSE '[TURN ' || role || ']' END AS opening,
  CASE role WHEN 'system' THEN '[/SYS]' WHEN 'user' THEN '[/INST]' WHEN 'assistant' THEN '</s>' ELSE '[/TURN]' END AS closing FROM t),
e AS (SELECT *, len(list_filter(['<s>', '</s>', '[SYS]', '[/SYS]', '[INST]', '[/INST]', '[TURN ', '[/TURN]'], lambda c: contains(text, c))) > 0 OR regexp_matches(text, '\\[\\blr]') AS conflict,
  length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '</?s>|\[/?SYS\]|\[/?INST\]|\[TURN |\[/TURN\]')) AS escaped FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(opening) + length(closing) + CASE WHEN hard THEN escaped ELSE length(text) END)::BIGINT AS formatted_chars, true AS round_trip
FROM (SELECT *, bool_or(conflict) OVER (PARTITION BY conv_id) AS hard FROM e) GROUP BY conv_id
"""

_LINES_SQL = r"""
WITH l AS (SELECT doc_id, source, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, source, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
k AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS core FROM l),
c AS (SELECT core FROM k WHERE len(regexp_extract_all(core, '[^\x20\x09-\x0D]+')) >= 3 GROUP BY core HAVING count(DISTINCT coalesce('s' || source, '')) >= 6)
SELECT doc_id, count(*) AS n_lines, count(c.core) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.core IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.core = c.core GROUP BY doc_id
"""

_LEAKS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, ws[i:i+least(10, len(ws))-1] AS g FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, i, n, ws[i:i+n-1] AS g FROM (SELECT doc_id, ws, s.n, unnest(generate_series(1, len(ws) - s.n + 1)) AS i FROM w, (SELECT DISTINCT n FROM i) s)),
h AS (SELECT doc_id, d.i, d.n, item_id FROM d JOIN i ON d.n = i.n AND d.g = i.g),
x AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(h.i, h.i + h.n - 1)) AS p FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS v FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": _QUALITY_SQL,
        "op5_jaccard_join": _JACCARD_SQL,
        "op6_chat_format": _CHAT_SQL,
        "op8_line_dedup": _LINES_SQL,
        "op10_decontaminate": _LEAKS_SQL,
    }
