"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, seq, message_id, op, role, text). Logs are partitioned by
conversation and sorted by sequence; the events of a message fold into its final text:
`message`, `edit` and `regenerate` set role and text anew, `delta` appends, `delete`
removes. Messages follow each other in the order of their first event and are rendered
with a template whose control strings cannot occur inside an escaped text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import bound
from .common import running

# The template's control strings.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CLOSED = r"<\|im_end\|>\n"

RESETS = ("message", "edit", "regenerate", "delete")


def fold_log(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, ord, message_id, role, text) of a log.

    Events of equal seq follow in the order of op and text. A null text is empty, a null role
    is the empty role, an unknown op counts as `delta`, deltas without a preceding reset start
    from the empty text. Deleted messages are gone. One shuffle, by conversation.
    """
    log = events.select(
        "conv_id",
        "message_id",
        F.struct(
            F.col("seq").cast("long").alias("seq"),
            F.coalesce(F.col("op"), F.lit("delta")).alias("op"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        ).alias("event"),
    )
    folded = log.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list("event")).alias("events"))
    last = F.array_max(F.transform("events", lambda e, i: F.when(e["op"].isin(*RESETS), i).otherwise(0)))
    tail = F.slice("events", last + 1, F.size("events"))
    return folded.select("conv_id", "message_id", F.col("events")[0]["seq"].alias("ord"), tail.alias("tail")).select(
        "conv_id",
        "ord",
        "message_id",
        F.col("tail")[0]["role"].alias("role"),
        F.array_join(F.transform("tail", lambda e: e["text"]), "").alias("text"),
        (F.col("tail")[0]["op"] == "delete").alias("gone"),
    ).filter(~F.col("gone")).drop("gone")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans of assistant texts in it, code points, and the turns they are in).

    Messages are ordered by (ord, message_id).
    """
    turns = messages.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "message_id", "role", "text"))).alias("turns")
    )
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("learn"),
        ),
    )
    sizes = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE))
    # A piece ends where the sum of all sizes up to it says.
    starts = F.zip_with(
        "pieces",
        "ends",
        lambda p, end: F.struct((end - len(CLOSE) - F.length(p["body"])).cast("int").alias("start"), F.length(p["body"]).alias("length"), p["learn"].alias("learn")),
    )
    shaped = turns.select("conv_id", pieces.alias("pieces")).withColumn("ends", running(sizes))
    return shaped.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(
            F.filter(F.transform(starts, lambda s, i: F.struct(s["start"], s["length"], i.alias("turn"), s["learn"])), lambda s: s["learn"]),
            lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), s["turn"].alias("turn")),
        ).alias("loss"),
    )


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, in order, as they stand in `formatted`.

    The rendered string is split once; a span is cut out of the piece it is in, whose place the running lengths tell.
    """
    parts = F.split(formatted, CLOSED, -1)

    def cut(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda p: F.length(p) + len(CLOSE))
        return bound(running(sizes), lambda ends: F.transform(loss, lambda s: within(F.get(pieces, s["turn"]), F.get(ends, s["turn"]), s)))

    def within(piece: Column, end: Column, span: Column) -> Column:
        base = end - len(CLOSE) - F.length(piece)
        return F.substring(piece, (span["start"] - base + 1).cast("int"), span["length"])

    return bound(parts, cut)


def parse(formatted: Column) -> Column:
    """The turns (role, text) read back from a rendered conversation."""
    parts = F.split(formatted, CLOSED, -1)
    turn = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)$"
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, turn, 1)).alias("role"),
            unescape(F.regexp_extract(p, turn, 2)).alias("text"),
        ),
    )


def turns_log(conversations: DataFrame) -> DataFrame:
    """A table with one row per turn as a log: each row is a message of its own.

    Rows are numbered by turn, then role and text, so repeated rows and ties stay apart.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("seq"),
        F.row_number().over(order).cast("long").alias("message_id"),
        F.lit("message").alias("op"),
        "role",
        "text",
    )


def chat_report(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its rendered form; see fold_log and turns_log for nulls and ties.

    A null conv_id is a conversation of its own; no rows give none; other columns are not looked at.
    """
    rendered = render(fold_log(turns_log(conversations)))
    read = rendered.select(
        "conv_id",
        "formatted",
        parse(F.col("formatted")).alias("turns"),
        bound(
            F.array_join(F.transform(masked(F.col("formatted"), F.col("loss")), unescape), ""),
            lambda t: F.struct(F.length(t).cast("long").alias("chars"), F.sha2(t.cast("binary"), 256).alias("sha256")),
        ).alias("learned"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.col("learned.chars").alias("loss_chars"),
        F.col("learned.sha256").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"

ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
                + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
