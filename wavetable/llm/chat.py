"""Chat formatting from an event log: fold the events into final messages, render them, and read them back.

A log holds, per conversation and in the order of a sequence number, the events of its messages (numbered from 0):

``start``       a message begins, with its role
``delta``       streamed text, appended to its message
``edit``        the text of its message is replaced
``regenerate``  its message starts anew without text, and all messages behind it are gone

The log is partitioned by conversation once; everything else happens inside that partitioning.  An event
survives if no later regeneration reaches its message and no later edit of the same message follows; windows
over the events find that without gathering them, so only text of the final messages is ever collected.

Rendering marks every turn as ``### role: text</turn>`` and a line end.  Inside texts and roles the characters that marks are
made of are written as a backslash and a letter, so no mark can occur in them and reading back is a literal split.  The
loss mask is a list of byte spans of the assistants' texts.

All of it is column functions and windows.  One conversation is one formatted string, so it must fit into a row (2 GB).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetable.llm.common import query, table

HEAD, COLON, END = "### ", ": ", "</turn>\n"
CODES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]  # the backslash comes first when escaping and last when reading back
ROLE_CODES = [*CODES, (":", "\\c")]
LEARNED = "assistant"


def escaped(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), codes, text)


def unescaped(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), reversed(codes), text)


def log_of_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The event log of a table of finished turns: (key, seq, message, kind, role, text).

    Turns are numbered by ``turn`` (null first), then role and text; repeated rows are turns of their own.  An assistant's text was drafted
    once and regenerated, then streamed in two deltas; any other text was typed as a delta and edited.  Null role or text is empty.
    """
    at = Window.partitionBy("key").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = turns.select(F.col(key).alias("key"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    rows = rows.withColumn("message", F.row_number().over(at).cast("long") - 1)
    t, none = F.col("text"), F.lit("")
    half = (F.char_length(t) / 2).cast("int")
    first, rest = F.substr(t, F.lit(1), half), F.substr(t, half + 1)
    drafted = [("start", F.col("role"), none), ("delta", none, rest), ("regenerate", none, none), ("delta", none, first), ("delta", none, rest)]
    typed = [("start", F.col("role"), none), ("delta", none, first), ("edit", none, t)]
    listed = [F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), r.alias("role"), x.alias("text")) for i, (k, r, x) in enumerate(events)]) for events in (drafted, typed)]
    events = rows.select("key", "message", F.explode(F.when(F.col("role") == LEARNED, listed[0]).otherwise(listed[1])).alias("e"))
    return events.select(F.col("key").alias(key), (F.col("message") * 8 + F.col("e.i")).alias("seq"), "message", "e.kind", "e.role", "e.text")


def messages(log: DataFrame, key: str = "conv_id", seq: str = "seq", message: str = "message", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(key, message, role, text): the final messages that the events of each conversation fold into.

    Events count in the order of ``seq`` (null first; equal numbers by kind, then text).  An event that
    was delivered twice, equal in all columns, is one.  The role is that of the last start; without one, and for
    nulls, it is empty.  Null texts are empty; events of other kinds or without a message number do nothing.  A null key
    is a conversation like any other.  A message none of whose starts, deltas and edits survive does not exist.
    """
    e = log.select(
        F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(message).cast("long").alias("message"), F.col(kind).alias("kind"),
        *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))],
    ).where(F.col("message").isNotNull() & F.col("kind").isin("start", "delta", "edit", "regenerate"))
    written = F.col("kind").isin("delta", "edit")
    order = [F.desc_nulls_last("seq"), F.desc("kind"), F.desc("text")]
    later = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("reach", F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later))
    e = e.where((F.col("kind") != "regenerate") & (F.col("reach").isNull() | (F.col("reach") > F.col("message")) | (~written & (F.col("reach") == F.col("message")))))
    same = Window.partitionBy("key", "message").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # an edit that was delivered twice is hidden by its own copy, but one of the two survives
    e = e.withColumn("edits", F.coalesce(F.sum(F.when(F.col("kind") == "edit", 1).otherwise(0)).over(same), F.lit(0))).where(~written | (F.col("edits") == 0))
    part = F.when(written, F.struct("seq", "kind", "text"))
    folded = e.groupBy("key", "message").agg(F.max(F.when(~written, F.struct("seq", "role"))).alias("began"), F.sort_array(F.collect_set(part)).alias("parts"))
    final = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return folded.select(F.col("key").alias(key), "message", F.coalesce("began.role", F.lit("")).alias("role"), final.alias("text"))


def render(final: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, formatted, loss): the turns of each conversation in one string, and the byte spans (start, length) to learn from.

    ``final``: (key, message, role, text) without nulls in role and text, as :func:`messages` gives it; messages are rendered in the order of their numbers.
    """
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), ROLE_CODES), F.lit(COLON))
    turn = final.select(F.col(key).alias("key"), "message", (F.col("role") == LEARNED).alias("learned"), head.alias("head"), escaped(F.col("text")).alias("body"))
    before = Window.partitionBy("key").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    width = F.octet_length("head") + F.octet_length("body") + len(END)
    turn = turn.withColumn("start", (F.coalesce(F.sum(width).over(before), F.lit(0)) + F.octet_length("head")).cast("int"))
    piece = F.struct("message", F.concat("head", "body", F.lit(END)).alias("piece"))
    span = F.when(F.col("learned"), F.struct("start", F.octet_length("body").alias("length")))
    whole = turn.groupBy("key").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.sort_array(F.collect_list(span)).alias("loss"))
    return whole.select(F.col("key").alias(key), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss")


def turns_of(formatted: Column) -> Column:
    """array of (role, text) read back from a formatted string."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")

    def turn(piece: Column) -> Column:
        parts = F.split(F.substr(piece, F.lit(len(HEAD) + 1)), COLON, 2)
        return F.struct(unescaped(parts[0], ROLE_CODES).alias("role"), unescaped(parts[1]).alias("text"))

    return F.transform(pieces, turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, spans in order and nothing between them, as the assistants wrote it."""
    raw = formatted.cast("binary")
    return unescaped(F.array_join(F.transform(loss, lambda s: F.substr(raw, s["start"] + 1, s["length"]).cast("string")), ""))


def _sql_escaped(column: str, codes: list[tuple[str, str]]) -> str:
    return reduce(lambda c, p: f"replace({c}, '{p[0]}', '{p[1]}')", codes, column)


@query(
    "op12_event_chat",
    rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(HEAD) + len(COLON) + len(END)} + length({_sql_escaped("role", ROLE_CODES)}) + length({_sql_escaped("text", CODES)})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
)
def op12(spark, sf):
    probe = r"\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise(LEARNED)
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(probe).alias("text"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = render(messages(log_of_turns(turns)))
    lines = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = done.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
