"""Chats for training, rebuilt from event logs and written with a template.

Event-sourced reconstruction: a log holds what happened to messages, by conversation and sequence number. `open` gives a
message (numbered from 0 or 1 in its conversation) its role, `delta` appends streamed text, `edit` replaces `length` code points from `start` by
text, `regenerate` starts a message's text anew and withdraws the messages after it that came before in sequence. The log is
folded into final messages, which are rendered, one conversation a row, with a loss mask.

Folding is dealt out by message and ordered by sequence; runs of deltas between two edits are joined at once, so that a long
stream costs no more than its length. Only DataFrame functions are used. A conversation is gathered once, at the end,
since its formatted text is one value (which Spark holds to 2 GB).

Results where the data are odd: NULL texts and roles read as empty; a NULL sequence number comes first; at equal numbers deltas come
before edits and edits before regenerations. An event delivered twice counts once. A message that was never opened, or
was withdrawn and not opened again, isn't there. A NULL conv_id names one conversation like any other. An empty log gives no rows.
Texts may hold anything, control strings and their escaped forms included. Further columns of any name are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.blocks import prefix

#: The marks of this template, and those of another widespread one, which texts may not pass to a tokenizer either.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]")

_TAILS = "|".join(re.sub(r"([|\[\]])", r"\\\1", c[1:]) for c in CONTROL)
#: The first character of a control string, backslashes, and its rest. No rest holds a first character, so matches never overlap.
ESCAPABLE, ESCAPED = rf"([<\[])(\\*)({_TAILS})", rf"([<\[])\\(\\*)({_TAILS})"
TURN_END = END.replace("|", r"\|") + "\n"
EVENTS = ("open", "delta", "edit", "regenerate")
_REST = 2**31 - 1


def escape(text: Column) -> Column:
    """Texts with one backslash more inside each control string or escaped form of one; unescape() takes it out."""
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role on one line."""
    return escape(F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def withdrawals(events: DataFrame) -> DataFrame:
    """(_conv, message, cut): the last sequence number at which an earlier message was regenerated, where there was one.

    A running maximum over messages, by blocks: one conversation may hold any share of them.
    """
    last = events.groupBy("_conv", "message").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("_seq"))
    later = last.where("_seq IS NOT NULL").select("_conv", (F.col("message") + 1).alias("message"), "_seq")
    known = last.select("_conv", "message", F.lit(None).cast("bigint").alias("_seq")).unionByName(later).groupBy("_conv", "message").agg(F.max("_seq").alias("_seq"))
    return prefix(known, ["_conv"], {"cut": ("max", "_seq")}, index="message").where("cut IS NOT NULL").select("_conv", "message", "cut")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, seq, message, kind, role, text, start, length) -> (conv_id, message, role, text) of all final messages."""
    log = events.select(F.struct("conv_id").alias("_conv"), F.coalesce("seq", F.lit(-(2**63))).alias("seq"), "message", "kind",
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "start", "length")
    live = log.join(withdrawals(log), ["_conv", "message"], "left").where("cut IS NULL OR seq >= cut")
    # `seq, kind` is the order: the kinds' names happen to stand as they should.
    w = Window.partitionBy("_conv", "message").orderBy("seq", "kind")
    whole = Window.partitionBy("_conv", "message")
    kind = F.col("kind")
    marked = live.withColumns({
        "_fresh": F.max(F.when(kind == "regenerate", F.col("seq"))).over(whole),
        "_epoch": F.last(F.when(kind.isin("edit", "regenerate"), F.col("seq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    own = F.col("_fresh").isNull() | (F.col("seq") > F.col("_fresh")) | kind.isin("open", "regenerate")
    item = F.struct("seq", "text", "start", "length")
    listed = lambda k: F.array_distinct(F.array_sort(F.collect_list(F.when(kind == k, item))))
    epochs = marked.where(own).groupBy("_conv", "message", "_epoch").agg(
        listed("edit").alias("edits"), F.array_join(F.transform(listed("delta"), lambda d: d["text"]), "").alias("piece"),
        F.max(F.when(kind == "open", F.struct("seq", "role"))).alias("opened"))

    def spliced(text: Column, edit: Column) -> Column:
        before = F.substring(text, F.lit(1), edit["start"].cast("int"))
        return F.concat(before, edit["text"], F.substring(text, (edit["start"] + edit["length"] + 1).cast("int"), _REST))

    steps = F.array_sort(F.collect_list(F.struct("_epoch", "edits", "piece")))
    text = F.aggregate("steps", F.lit(""), lambda acc, e: F.concat(F.aggregate(e["edits"], acc, spliced), e["piece"]))
    folded = epochs.groupBy("_conv", "message").agg(steps.alias("steps"), F.max("opened").alias("opened")).where("opened IS NOT NULL")
    return folded.select(F.col("_conv.conv_id").alias("conv_id"), "message", F.col("opened.role").alias("role"), text.alias("text"))


def render(messages: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, message, piece, text_at, text_chars, loss): each message as it stands in its conversation's text.

    `text_at` and `text_chars` tell where in the piece its escaped text is; `loss` whether its role is learned.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    return messages.select("conv_id", "message", F.concat(head, body, F.lit(END + "\n")).alias("piece"), F.length(head).cast("bigint").alias("text_at"),
                           F.length(body).cast("bigint").alias("text_chars"), F.col("role").isin(*learned).alias("loss"))


def assemble(pieces: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the conversation's text, and for each turn the code points at which it and its text start and
    end, and whether the text is under the loss mask."""
    w = Window.partitionBy("_conv").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    chars = F.length("piece").cast("bigint")
    placed = pieces.withColumn("_conv", F.struct("conv_id")).withColumn("_start", F.sum(chars).over(w) - chars)
    text_start = (F.col("_start") + F.col("text_at")).alias("text_start")
    turn = F.struct("message", "piece", F.struct(F.col("_start").alias("start"), text_start, (text_start + F.col("text_chars")).alias("text_end"), "loss").alias("turn"))
    return placed.groupBy("_conv").agg(F.array_sort(F.collect_list(turn)).alias("_turns")).select(
        F.col("_conv.conv_id").alias("conv_id"), F.array_join(F.col("_turns.piece"), "").alias("formatted"), F.col("_turns.turn").alias("turns"))


def format_chats(events: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: the log's final messages in the template, with the loss mask."""
    return assemble(render(reconstruct(events), learned))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns) -> (conv_id, messages, learned, formatted_chars).

    `messages` (role, text) come from the text's marks alone, `learned` (the unescaped texts under the mask) from the mask's places.
    """
    pieces = F.slice(F.split("formatted", TURN_END), 1, F.size(F.split("formatted", TURN_END)) - 1)
    line = lambda p: F.substring_index(p, "\n", 1)
    message = lambda p: F.struct(unescape_role(F.substring(line(p), F.lit(len(START) + 1), _REST)).alias("role"),
                                 unescape(F.substring(p, F.length(line(p)) + 2, _REST)).alias("text"))
    held = formatted.withColumn("_pieces", pieces)
    covered = F.zip_with("_pieces", "turns", lambda p, t: F.when(t["loss"], F.substring(p, (t["text_start"] - t["start"] + 1).cast("int"), (t["text_end"] - t["text_start"]).cast("int"))))
    return held.select("conv_id", F.transform("_pieces", message).alias("messages"),
                       F.transform(F.filter(covered, lambda c: c.isNotNull()), unescape).alias("learned"), F.length("formatted").cast("bigint").alias("formatted_chars"))
