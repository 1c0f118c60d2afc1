r"""Chat formatting of typed content parts, in DataFrame operations only.

A turn becomes ``<s>role\ntext</s>``; a user's text also stands between ``[INST] `` and `` [/INST]``. A message is a list of typed
parts: text is escaped, and image, audio and document parts become one placeholder each, in order, while their references and
expanded token counts are recorded. Escaping doubles every backslash and puts a backslash behind the first character of each
control string, so that no control string occurs in an escaped text, and is undone by dropping one backslash of each escape.

The formatted conversation is one row. read_back() takes it apart again: only an unescaped ``</s>`` ends a turn.

Defined results: null text and null role are empty; turns sort by turn (null first), then role, then text, repeated rows stay;
a null conv_id is a conversation; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "array<struct<type:string,text:string,ref:string,tokens:int>>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens an attachment expands to where its part doesn't say.
DEFAULT_TOKENS = {"image": 576, "audio": 1500, "document": 1024}
_CONTROL = r"<(?=s>|/s>|\|(?:image|audio|document)\|>)|\[(?=/?INST\])"
_HEAD = r"(?s)^<s>((?:[^\\\n]++|\\.)*+)\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def flatten(parts: Column) -> Column:
    """The visitor: parts in order, as one string. Unknown types count as text."""

    def visit(p: Column) -> Column:
        out = escape(F.coalesce(p["text"], F.lit("")))
        for kind, mark in PLACEHOLDERS.items():
            out = F.when(p["type"] == kind, F.lit(mark)).otherwise(out)
        return out

    return F.array_join(F.transform(parts, visit), "")


def attachments(parts: Column) -> Column:
    """type, ref, tokens of the attachments, in the order of their placeholders."""
    known = F.filter(parts, lambda p: F.coalesce(p["type"].isin(*PLACEHOLDERS), F.lit(False)))

    def tokens(p: Column) -> Column:
        out = F.lit(0)
        for kind, n in DEFAULT_TOKENS.items():
            out = F.when(p["type"] == kind, F.lit(n)).otherwise(out)
        return F.coalesce(p["tokens"], out)

    return F.transform(known, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))


def with_parts(messages: DataFrame) -> DataFrame:
    """Plain texts as messages of one text part."""
    text = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))
    return messages.withColumn("parts", F.array(text))


def format_chats(messages: DataFrame) -> DataFrame:
    """messages: conv_id, turn, role, parts. A row per conversation: conv_id, formatted, mask (a boolean per turn), loss_spans
    (start, end in code points of formatted), attachments, expanded_tokens.
    """
    parts = F.coalesce(F.col("parts").cast(PART), F.expr(f"cast(array() as {PART})"))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts")).withColumn("text", flatten(F.col("parts")))
    head = F.concat(F.lit("<s>"), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"), F.when(F.col("role") == "user", "[INST] ").otherwise(""))
    rows = rows.withColumn("piece", F.concat(head, "text", F.when(F.col("role") == "user", " [/INST]</s>").otherwise("</s>")))
    rows = rows.withColumns({"head": F.length(head).cast("long"), "long": F.length("text").cast("long"), "whole": F.length("piece").cast("long"), "loss": F.col("role") == "assistant", "held": attachments(F.col("parts"))})
    rows = rows.withColumn("at", F.expr("sum(whole) over (partition by conv_id order by turn, role, text rows unbounded preceding) - whole"))
    turn = F.struct("turn", "role", "text", "at", "piece", "loss", (F.col("at") + F.col("head")).alias("start"), (F.col("at") + F.col("head") + F.col("long")).alias("end"), "held")
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    held = F.flatten(F.transform("turns", lambda t: t["held"]))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    out = out.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.transform("turns", lambda t: t["loss"]).alias("mask"), spans.alias("loss_spans"), held.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation: an array of (role, text)."""
    cuts = F.split(formatted, "</s>", -1)
    turns = F.slice(cuts, F.lit(1), F.size(cuts) - 1)

    def turn(t: Column) -> Column:
        body = F.regexp_replace(t, _HEAD, "")
        user = body.startswith("[INST] ") & body.endswith(" [/INST]") & (F.length(body) >= 15)
        text = F.when(user, F.substring(body, F.lit(8), F.length(body) - 15)).otherwise(body)
        return F.struct(unescape(F.regexp_extract(t, _HEAD, 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def under_mask(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, read from the output: what the spans cut out of it, unescaped, one after the other."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
