"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A log row is (conv_id, seq, kind, message_id, role, text). Rows are dealt out by conversation,
sorted by sequence and folded:

* ``message``     starts a message with its first text; a second one with the same id restarts it;
* ``delta``       appends to its message (streamed output);
* ``edit``        replaces the text of its message, later deltas append to the new text;
* ``regenerate``  empties its message (``text`` is the first piece of the new one) and discards all
                  messages that began after it and before the regeneration.

A row without ``message_id`` is a message of its own. The text is shuffled once: the windows of
the fold and the final aggregates all use the one exchange by ``conv_id``. A conversation is one
output string, so its rows do meet in one task; nothing larger does.

Template: ``### role: text</turn>`` and a line feed per turn. In texts ``\\`` becomes ``\\\\``, ``#``
becomes ``\\#`` and ``</`` becomes ``<\\/``; roles are percent-coded; neither marker can occur inside.

Defined results: null text is empty; null role is the empty role; null ``seq`` sorts first; a null
conversation id is one conversation; unknown kinds and events of a message that never started are
ignored; ties in ``seq`` are ordered by kind (as listed above), id, role, text; repeated rows without
id are separate messages; a conversation whose messages are all discarded yields no row; an empty
log yields none. Further columns of the log are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("message", "delta", "edit", "regenerate")
END = "</turn>\n"


def escape(text: Column) -> Column:
    for raw, coded in (("\\", "\\\\"), ("#", "\\#"), ("</", "<\\/")):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


_ROLE_CODES = (("%", "%25"), (":", "%3A"), ("#", "%23"), ("<", "%3C"))


def escape_role(role: Column) -> Column:
    for raw, coded in _ROLE_CODES:
        role = F.replace(role, F.lit(raw), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for raw, coded in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(coded), F.lit(raw))
    return role


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold a log into final messages: (conv_id, born, role, text), ``born`` ordering them."""
    e = events.select(
        F.col("conv_id"), F.col("seq"), F.col("message_id").cast("string").alias("message_id"),
        F.array_position(F.array(*map(F.lit, KINDS)), F.lower("kind")).alias("rank"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter(F.col("rank") > 0).repartition("conv_id")
    in_order = W.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), "rank", "message_id", "role", "text")
    e = e.withColumn("pos", F.row_number().over(in_order))
    e = e.withColumn("message", F.when(F.col("message_id").isNotNull(), F.concat(F.lit("m"), "message_id"))
                     .otherwise(F.concat(F.lit("p"), F.col("pos").cast("string"))))
    own = W.partitionBy("conv_id", "message")
    e = (e.withColumn("born", F.min(F.when((F.col("rank") == 1) | F.col("message_id").isNull(), F.col("pos"))).over(own))
         .withColumn("restart", F.max(F.when(F.col("rank") != 2, F.col("pos"))).over(own)))
    # The earliest message any later regeneration goes back to.
    later = W.partitionBy("conv_id").orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("back_to", F.min(F.when(F.col("rank") == 4, F.col("born"))).over(later))
    e = e.withColumn("dead", F.max(F.coalesce((F.col("pos") == F.col("born")) & (F.col("back_to") < F.col("born")),
                                              F.lit(False))).over(own))
    live = e.filter(F.col("born").isNotNull() & ~F.col("dead")
                    & ((F.col("pos") >= F.coalesce("restart", "born")) | (F.col("pos") == F.col("born"))))
    piece = F.when(F.col("pos") >= F.coalesce("restart", "born"), F.col("text")).otherwise(F.lit(""))
    return live.groupBy("conv_id", "born").agg(
        F.min_by("role", "pos").alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece")))),
                                 lambda x: x["piece"]), "").alias("text"))


def render(messages: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, turns): the training string and, per turn, ``start`` and ``length`` of its
    escaped text in it (code points, from 0) and whether the loss mask covers it (``trained``)."""
    head = F.concat(F.lit("### "), escape_role(F.col("role")), F.lit(": "))
    body = escape(F.col("text"))
    turn = messages.select("conv_id", "born", F.concat(head, body, F.lit(END)).alias("turn"),
                           F.length(head).alias("head"), F.length(body).alias("length"),
                           F.col("role").isin(*trained_roles).alias("trained"))
    before = W.partitionBy("conv_id").orderBy("born").rowsBetween(W.unboundedPreceding, -1)
    turn = turn.withColumn("start", F.col("head") + F.coalesce(
        F.sum((F.col("head") + F.col("length") + len(END)).cast("long")).over(before), F.lit(0)))
    rows = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("born", "turn", "start", F.col("length").cast("long").alias("length"), "trained"))).alias("t"))
    return rows.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"),
                                            x["trained"].alias("trained"))).alias("turns"))


def format_chats(events: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    return render(reconstruct(events), trained_roles)


def read_back(formatted: Column, turns: Column) -> Column:
    """Parse a formatted conversation: array of (role, text, trained), texts unescaped."""
    parts = F.split(formatted, "</turn>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def parse(part: Column, turn: Column) -> Column:
        head = F.substring_index(part, ": ", 1)
        return F.struct(unescape_role(F.substr(head, F.lit(5))).alias("role"),
                        unescape(F.substr(part, F.length(head) + 3)).alias("text"),
                        turn["trained"].alias("trained"))
    return F.zip_with(parts, turns, parse)


def turn_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log: one ``message`` per row."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"),
                                F.lit(None).cast("string").alias("message_id"), "role", "text")
