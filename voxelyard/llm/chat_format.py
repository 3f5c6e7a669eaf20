"""Chat formatting of typed content parts, with DataFrame functions only.

A conversation's turns are laid in order into one string. Each turn is
``<|turn|>role<|text|>content<|end|>``; the visitor writes a text part with its control characters
escaped (``%`` as %25, ``<`` as %3C, ``[`` as %5B, so no marker of this or of other templates can
come out of a text), and any other part as an ordered placeholder ``<|image|>``, ``<|audio|>``,
``<|document|>``, while its reference, place and expanded token count go to ``attachments``.
``loss_mask`` says for each turn how many code points of the string come before the text under the
loss, are under it, and come after it. ``read_back`` parses the string again, takes what the mask
covers and undoes the escapes.

Defined results: null roles and texts are empty; turns are ordered by (turn, role, text), nulls
first, so ties and repeated rows are kept in a fixed order; rows of a null conv_id form one
conversation; a part of an unknown or null type is read as text; an empty table gives no
conversations; further columns are ignored. Texts of any length go through whole; a conversation is
one row of the result, so its texts must fit in one row (2 GB), once as they come and once formatted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
KINDS = ("image", "audio", "document")
#: Tokens for each unit of an attachment: an image's tile, a second of audio, a document's page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"))
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(c: Column) -> Column:
    for raw, coded in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(raw))
    return c


def visit(part: Column) -> Column:
    """A part as it stands in the output."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind in KINDS:
        out = F.when(part["type"] == kind, F.lit(f"<|{kind}|>")).otherwise(out)
    return out


def expanded(part: Column) -> Column:
    out = F.lit(0).cast("long")
    for kind in KINDS:
        out = F.when(part["type"] == kind, F.coalesce(part["units"], F.lit(1)) * TOKENS_PER_UNIT[kind]).otherwise(out)
    return out


def text_parts(rows: DataFrame) -> DataFrame:
    """Plain (conv_id, turn, role, text) rows, each text as the only part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_chat(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, attachments, loss_mask) of rows (conv_id, turn, role, parts array<PART>). One
    shuffle on conv_id, which carries a text once: as it is where a turn has no attachment."""
    flat = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.when(
                F.exists(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p["type"].isin(*KINDS)),
                F.array_join(F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visit), ""),
            ).alias("content"),
            F.transform(F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p["type"].isin(*KINDS)), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens"))).alias("files"),
            F.array_join(F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("raw"),
        ).alias("t"),
    )
    key = lambda t: F.struct(t["turn"].alias("a"), t["role"].alias("b"), t["raw"].alias("c"), t["content"].alias("d"), t["files"].alias("e"))
    turns = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(key(F.col("t")))).alias("turns"))
    laid = F.transform("turns", lambda t: F.struct(t["b"].alias("role"), F.concat(F.lit(TURN), escape(t["b"]), F.lit(TEXT)).alias("head"), F.coalesce(t["d"], escape(t["c"])).alias("content")))
    turns = turns.select("conv_id", F.flatten(F.transform("turns", lambda t: t["e"])).alias("attachments"), laid.alias("laid"))

    def mask(t: Column) -> Column:
        under = F.when(t["role"] == "assistant", F.length(t["content"])).otherwise(0)
        return F.struct((F.length(t["head"]) + F.length(t["content"]) - under).alias("before"), under.alias("under"), F.lit(len(END)).alias("after"))

    formatted = F.array_join(F.transform("laid", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "")
    return turns.select("conv_id", formatted.alias("formatted"), "attachments", F.transform("laid", mask).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and digests, parsed from ``formatted`` alone, and the text that ``loss_mask`` covers there."""
    places = "|".join(rf"<\|{k}\|>" for k in KINDS)
    turns = F.slice(F.split("formatted", r"<\|turn\|>"), F.lit(2), F.greatest(F.size(F.split("formatted", r"<\|turn\|>")) - 1, F.lit(0)))
    parsed = formatted.withColumn(
        "turns",
        F.transform(
            turns,
            lambda x: F.struct(
                unescape(F.substring_index(x, TEXT, 1)).alias("role"),
                unescape(F.regexp_replace(F.substring_index(F.substring_index(x, END, 1), TEXT, -1), places, "")).alias("text"),
            ),
        ),
    )
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    covered = F.zip_with(turns, "loss_mask", lambda x, m: F.substring(x, m["before"] - len(TURN) + 1, m["under"]))
    loss = F.array_join(F.transform(covered, lambda x: unescape(F.regexp_replace(x, places, ""))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
    )


EXTRA = "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_chat(text_parts(rows.unionByName(spark.sql(EXTRA)))))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'))
         + length(replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B')))::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments
FROM c GROUP BY conv_id
"""
