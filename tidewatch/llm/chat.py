"""Event-sourced chat formatting, with DataFrame functions only.

A log holds what happened in conversations: whole messages, streamed deltas, edits, regenerations and retractions.
Events are dealt by conversation and message and folded in the order of their sequence: a ``message``, ``edit`` or
``regenerate`` sets the text anew, a ``delta`` adds to it, a ``retract`` takes the message away.  As a later reset
makes all before it void, the fold is: find the last reset of a message, join what follows.  Messages then render in
the order of their first event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import text_of

TURN_START = "<s>"
TURN_END = "</s>"
#: Strings that the template, or a reader of it, takes as control; inside texts a backslash follows their first letter.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
DELTA_CHARS = 256
RESETS = ("message", "edit", "regenerate")


def fold_events(events: DataFrame) -> DataFrame:
    """``(conv_id, message_id, first_seq, role, text)`` of messages that are not retracted.

    Events: ``conv_id, message_id, seq, kind, role, text``.  A null text adds nothing; of events with one sequence
    number resets come first, then the smaller text; an event that arrives twice counts once.  The role is that of the last event that names one.
    """
    item = F.struct("seq", (~F.col("kind").isin(*RESETS)).alias("adds"), F.coalesce("text", F.lit("")).alias("text"), "kind", "role")
    grouped = events.groupBy("conv_id", "message_id").agg(
        F.sort_array(F.collect_set(item)).alias("log"), F.min("seq").alias("first_seq"),
        F.max(F.when(F.col("kind") == "retract", 1).otherwise(0)).alias("retracted"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
    )
    last_reset = F.greatest(F.lit(1), F.aggregate(
        F.transform("log", lambda e, i: F.when(~e.adds, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b)
    ))
    kept = grouped.where("retracted = 0").withColumn("from", last_reset)
    text = F.array_join(F.transform(F.slice("log", F.col("from"), F.size("log")), lambda e: e.text), "")
    return kept.select("conv_id", "message_id", "first_seq", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def escape(text: Column, breaks: bool = False) -> Column:
    """Backslashes double and control strings are broken by one; with ``breaks`` a line end is written as one and an n."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if breaks else out


def unescape(text: Column, breaks: bool = False) -> Column:
    """Undo ``escape``: every backslash stands for the letter after it.

    With ``breaks`` the text is cut at double backslashes first; in the parts a backslash and an n are a line end.
    """
    if not breaks:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")
    plain = lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_spans)``: one text a conversation and the (start, length) of assistant texts in it.

    A turn is ``<s>role``, a line end, the escaped text, ``</s>``.  Starts count from 1, in code points.
    """
    turn = F.struct("first_seq", "message_id", "role", "text")
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(TURN_START), escape(t.role, breaks=True), F.lit("\n")).alias("head"), escape(t.text).alias("body"),
        (t.role == "assistant").alias("learned"),
    ))
    sized = turns.select("conv_id", parts.alias("parts"))
    size = lambda p: F.length(p.head) + F.length(p.body) + len(TURN_END)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    walked = F.aggregate("parts", start, lambda s, p: F.struct(
        (s.at + size(p)).alias("at"),
        F.when(p.learned, F.concat(s.spans, F.array(F.struct((s.at + F.length(p.head)).alias("start"), F.length(p.body).alias("length"))))).otherwise(s.spans).alias("spans"),
    ))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(TURN_END))), "")
    return sized.select("conv_id", text.alias("formatted"), walked.spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns array<struct<role,text>>, loss_texts array<string>, formatted_chars)`` from the rendered text.

    The first line end of a turn ends its head, as heads hold none; roles and texts may have any length.
    """
    pieces = F.filter(F.split("formatted", r"</s>"), lambda x: x != "")
    turns = F.transform(pieces, lambda x: F.struct(
        unescape(F.substr(F.substring_index(x, "\n", 1), F.lit(len(TURN_START) + 1)), breaks=True).alias("role"),
        unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text"),
    ))
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s.start, s.length)))
    return formatted.select("conv_id", turns.alias("turns"), masked.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def logged(conversations: DataFrame, every_row: bool = False) -> DataFrame:
    """The log that rows ``(conv_id, turn, role, text)`` come from.

    User texts are a message; every fourth was a shorter draft first and then edited.  Other texts stream in deltas,
    every third after an attempt that was regenerated.  Rows that share a turn are messages of their own, ordered by
    role and text.  Rows equal in all of these columns are one message, or with ``every_row`` numbered and a message
    each.  Null texts and roles count as empty, null turns come after all others.  Further columns are not read, whatever
    their names; an empty table gives an empty log.  Texts and roles of any length are taken whole.
    """
    text = text_of()
    role = F.coalesce("role", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    number = []
    if every_row:  # equal rows are counted before they are dealt, then numbered
        counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
        rows = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        number = ["copy"]
    order = F.struct(F.col("turn").isNull().alias("no_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), "role", F.sha2("text", 256).alias("digest"), *number)
    event = lambda step, kind, text: F.struct(F.lit(step).alias("step") if isinstance(step, int) else step.alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
    pieces = F.greatest(F.lit(1), F.ceil(F.length("text") / DELTA_CHARS).cast("int"))
    deltas = F.transform(F.sequence(F.lit(0), pieces - 1), lambda k: event(k + 2, "delta", F.substr(F.col("text"), k * DELTA_CHARS + 1, F.lit(DELTA_CHARS))))
    draft = F.substring("text", 1, 20)
    turn = F.coalesce(F.col("turn"), F.lit(0))
    from_user = F.when(F.pmod(turn, F.lit(4)) == 0, F.array(event(0, "message", draft), event(1, "edit", F.col("text")))).otherwise(F.array(event(0, "message", F.col("text"))))
    streamed = F.when(
        F.pmod(turn, F.lit(3)) == 0, F.concat(F.array(event(0, "delta", F.reverse(draft)), event(1, "regenerate", F.lit(""))), deltas)
    ).otherwise(deltas)
    events = rows.select("conv_id", order.alias("message_id"), "role", F.explode(F.when(F.col("role") == "user", from_user).otherwise(streamed)).alias("e"))
    return events.select("conv_id", "message_id", F.struct("message_id", F.col("e.step").alias("step")).alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def control_conversation(spark: SparkSession, conv_id: int = -7) -> DataFrame:
    """A user and an assistant turn that both say control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    return spark.range(2).select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
