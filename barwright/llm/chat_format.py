"""Chat rendering that is proved by a grammar round trip, in SQL functions only.

A conversation is a sequence of ``<s>[INST role] text [/INST]</s>\\n``. Each conversation is first
rendered as it stands and parsed back; where the recovered turns differ from the source, its texts
are rendered again with control strings escaped (one backslash after the opening bracket, more if
there are some already), which the parser takes away. ``round_trip`` says whether the final text
parses back to the source exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import scan

#: Fixed strings of the template.
OPEN, CLOSE = "<s>[INST ", " [/INST]</s>\n"
ESCAPE = (r"([<\[])(\\*/?(?:s>|INST))", r"$1\\$2")
UNESCAPE = (r"([<\[])\\(\\*/?(?:s>|INST))", "$1$2")
#: Role characters that would end the header early, and their codes; the first must come first.
ROLE_CODES = (("%", "%25"), ("]", "%5D"), ("[", "%5B"), ("<", "%3C"), ("\n", "%0A"))


def _role_in(role: Column) -> Column:
    for raw, code in ROLE_CODES:
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def _role_out(role: Column) -> Column:
    for raw, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def render(turns: Column, escape: bool) -> Column:
    """Text of an array of ``struct(role, text)``."""
    text = (lambda t: F.regexp_replace(t["text"], *ESCAPE)) if escape else (lambda t: t["text"])
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), _role_in(t["role"]), F.lit("] "), text(t), F.lit(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """Turns that the deterministic parser reads from a rendered text; null text gives null."""
    pieces = F.split(formatted, r" \[/INST\]</s>\n", -1)
    shape = r"(?s)^<s>\[INST ([^\]]*)\] (.*)$"
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(_role_out(F.regexp_extract(p, shape, 1)).alias("role"), F.regexp_replace(F.regexp_extract(p, shape, 2), *UNESCAPE).alias("text")),
    )


def format_chats(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col, turns, formatted, escaped, parsed, round_trip``.

    Null roles and texts are empty strings; turns sort by (order, role, text), a null order first, so
    ties and repeated rows have one defined order and all stay. A null conversation id is a
    conversation of its own. Columns besides the four are not read.
    """
    turn = F.struct(F.col(order_col).alias("at"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    whole = turns.groupBy(F.col(conv_col)).agg(F.sort_array(F.collect_list(turn)).alias("_all"))
    source = whole.select(conv_col, F.transform("_all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = source.withColumn("_plain", render(F.col("turns"), escape=False))
    tried = plain.withColumn("escaped", ~parse(F.col("_plain")).eqNullSafe(F.col("turns")))
    chosen = tried.withColumn("formatted", F.when(F.col("escaped"), render(F.col("turns"), escape=True)).otherwise(F.col("_plain")))
    return chosen.withColumn("parsed", parse(F.col("formatted"))).select(
        conv_col, "turns", "formatted", "escaped", "parsed", F.col("parsed").eqNullSafe(F.col("turns")).alias("round_trip")
    )


def loss_text(parsed: Column, learned: str = "assistant") -> Column:
    """All text under the loss mask: each text of the learned role once, in order."""
    return F.array_join(F.transform(F.filter(parsed, lambda t: t["role"] == learned), lambda t: t["text"]), "")


def loss_spans(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """Result of ``format_chats`` with ``loss_mask``: [start, end) code points of learned texts in ``formatted``."""
    pieces = F.transform(F.split("formatted", r" \[/INST\]</s>\n", -1), lambda p: F.struct(F.length(p).alias("n"), F.length(F.regexp_extract(p, r"^<s>\[INST [^\]]*\] ", 0)).alias("head"), (F.regexp_extract(p, r"^<s>\[INST ([^\]]*)\] ", 1) == learned).alias("learned")))
    span = lambda at, p: F.array(F.struct((at + p["head"]).cast("int").alias("start"), (at + p["n"]).cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    folded = scan(pieces, F.lit(0), lambda at, p: (at + p["n"] + len(CLOSE)).cast("int"), lambda at, p: F.when(p["learned"], span(at, p)).otherwise(none), none)
    return turns.withColumn("loss_mask", folded)
