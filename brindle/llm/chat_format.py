"""Chat formatting with a grammar round trip.

A conversation is rendered as its turns one after another, each between marks
of its role:

    system     [SYS] ... [/SYS]
    user       [INST] ... [/INST]
    assistant  <s> ... </s>
    others     [TURN role] ... [/TURN]

The parser reads a turn from its opening mark to the first closing mark of the
same kind and takes escapes back.  Each rendering is parsed again and compared
to the source, and no control string may stand in it but the marks themselves,
of whatever role: a text that holds one would open or close a turn for another
parser.  Where either fails, content is escaped, in levels: nothing, then control
strings and the escape character, then every bracket.  The first level that passes
is used, and ``round_trip`` says that it did.  All of it is DataFrame expressions.

Cases: a null text or role is empty (a null role is one of the others).  Turns
that tie in number follow in order of (role, text); a null turn comes first.  A
null conv_id is a conversation of its own.  Repeated rows are separate turns.
An empty table gives an empty result.  Further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of each role.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN ", "[/TURN]")
CONTROL = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[TURN ", "[/TURN]")

_GRAMMAR = r"(?s)\[SYS\].*?\[/SYS\]|\[INST\].*?\[/INST\]|<s>.*?</s>|\[TURN [^\]]*\].*?\[/TURN\]"
_CONTROL = r"</?s>|\[/?SYS\]|\[/?INST\]|\[TURN |\[/TURN\]"
_BLOCK = 256


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, level: int) -> Column:
    """The text with conflicting content escaped; a backslash begins every escape."""
    if level == 0:
        return text
    text = _replace(text, "\\", "\\\\")
    for c in CONTROL if level == 1 else ("<", "["):
        text = _replace(text, c, ("\\l" if c[0] == "<" else "\\b") + c[1:])
    return text


def unescape(text: Column) -> Column:
    """The inverse of every level: pairs of backslashes part the text first, so no escape is read across them."""
    plain = lambda x: _replace(_replace(_replace(x, "\\b", "["), "\\l", "<"), "\\r", "]")
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def _role_escape(role: Column) -> Column:
    return _replace(escape(role, 2), "]", "\\r")


def _render(turn: Column, level: int) -> Column:
    role, text = turn["role"], escape(turn["text"], level)
    out = F.concat(F.lit(OTHER[0]), _role_escape(role), F.lit("]"), text, F.lit(OTHER[1]))
    for name, (a, b) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(a), text, F.lit(b))).otherwise(out)
    return out


def split_turns(formatted: Column) -> Column:
    """The rendered turns, by the grammar; they make up the whole text, or it is malformed."""
    return F.regexp_extract_all(formatted, F.lit(_GRAMMAR), F.lit(0))


def _mark_lengths(piece: Column) -> tuple[Column, Column]:
    left, right = F.instr(piece, "]"), F.lit(len(OTHER[1]))
    for a, b in MARKS.values():
        left = F.when(piece.startswith(a), F.lit(len(a))).otherwise(left)
        right = F.when(piece.startswith(a), F.lit(len(b))).otherwise(right)
    return left, right


def _inner(piece: Column, left: Column, right: Column) -> Column:
    return piece.substr(left + 1, F.length(piece) - left - right)


def parse_turn(piece: Column) -> Column:
    """(role, text) of one rendered turn."""
    role = unescape(piece.substr(F.lit(len(OTHER[0]) + 1), F.instr(piece, "]") - len(OTHER[0]) - 1))
    for name, (a, _) in MARKS.items():
        role = F.when(piece.startswith(a), F.lit(name)).otherwise(role)
    return F.struct(role.alias("role"), unescape(_inner(piece, *_mark_lengths(piece))).alias("text"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    return F.transform(split_turns(formatted), parse_turn)


def _sums_before(lengths: str) -> Column:
    """For each element of an array column the sum of those before it, by blocks, so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * _BLOCK + 1, _BLOCK)))
    return F.transform(blocks, lambda _, i: total(F.slice(blocks, F.lit(1), i)))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, level, round_trip).

    ``loss_spans`` holds (start, end) in characters of the assistant texts within
    ``formatted``, escapes included: the loss mask.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", text("role").alias("role"), text("text").alias("text")))).alias("turns"))
    df = turns.withColumn("source", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    render = lambda level: F.array_join(F.transform("source", lambda x: _render(x, level)), "")
    marks_only = lambda c: F.regexp_count(c, F.lit(_CONTROL)) == 2 * F.size("source")
    same = lambda c: F.coalesce((parse(F.col(c)) == F.col("source")) & (F.array_join(split_turns(F.col(c)), "") == F.col(c)) & marks_only(c), F.lit(False))
    df = df.withColumn("formatted", render(0)).withColumn("exact", same("formatted")).withColumn("level", F.lit(0))
    for level in (1, 2):
        df = df.withColumn("formatted", F.when(F.col("exact"), F.col("formatted")).otherwise(render(level))).withColumn("level", F.when(F.col("exact"), F.col("level")).otherwise(F.lit(level)))
        df = df.withColumn("exact", F.col("exact") | same("formatted"))
    df = df.withColumn("pieces", split_turns(F.col("formatted"))).withColumn("lengths", F.transform("pieces", lambda x: F.length(x).cast("long")))
    df = df.withColumn("block_starts", _sums_before("lengths"))
    rest = lambda i: F.aggregate(F.slice("lengths", i - i % _BLOCK + 1, i % _BLOCK), F.lit(0).cast("long"), lambda x, y: x + y)
    start = lambda i: F.get("block_starts", F.floor(i / _BLOCK).cast("int")) + rest(i)
    left, right = (F.lit(len(x)) for x in MARKS["assistant"])
    spans = F.transform("pieces", lambda x, i: F.when(x.startswith(MARKS["assistant"][0]), F.struct((start(i) + left).alias("start"), (start(i) + F.length(x) - right).alias("end"))))
    return df.select("conv_id", "formatted", F.filter(spans, lambda x: x.isNotNull()).alias("loss_spans"), "level", F.col("exact").alias("round_trip"))


def masked_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.col(formatted).substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
