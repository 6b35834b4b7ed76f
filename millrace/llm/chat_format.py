"""Chat formatting from event logs, with DataFrame functions only.

A log has, per conversation, events in sequence: `message` begins a message, `delta` adds text to it, `edit` replaces its
text, `regenerate` empties it to be streamed anew and drops the messages of later turns that had begun. They are folded
to the final messages: per message the last event that set its text, and the deltas after that in order. Messages are
then rendered with marked turns; control strings inside texts are escaped so that the output can be read back exactly.

No task has a whole conversation but in the last step, where its formatted text is one row: events are grouped by
message, what regenerations drop and where texts begin is found for PART turns at a time, and then for the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import table

OPEN, CLOSE, SHUT = "<turn:", ">", "</turn>"
#: Reversible escapes, in the order in which they are made. None of their results holds a control string.
ESCAPES = (("\\", "\\e"), (OPEN, "\\o"), (SHUT, "\\c"), (CLOSE, "\\g"))
#: Turns that are joined in one task before the parts of a conversation are.
PART = 64
#: Characters of a streamed delta, and deltas of a text at most: longer texts have longer deltas.
PIECE, PIECES = 240, 1000


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def events_of(messages: DataFrame) -> DataFrame:
    """A log that folds to a table of finished messages (conv_id, turn, role, text): conv_id, turn, message (an id of the
    row), seq, kind, role, text.

    What assistants say is streamed as a draft, regenerated, and streamed again in deltas of PIECE characters (longer
    ones in long texts, PIECES at most); before the regeneration a reply to the draft has begun, which it drops. What others
    say is sent with a slip and edited. All follows from the row itself, and null texts stay empty; a row that repeats
    another has the same events at the same places, and an empty table has none.
    """
    text, turn = F.coalesce("text", F.lit("")), F.coalesce(F.col("turn").cast("long"), F.lit(0))
    piece = F.greatest(F.lit(PIECE), F.ceil(F.char_length(text) / PIECES)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.char_length(text) / piece).cast("int") - 1)), lambda k: F.substring(text, k * piece + 1, piece))
    event = lambda kind, text_, at, turn_=F.col("turn").cast("long"), message=F.col("message"): F.struct(
        turn_.alias("turn"), message.alias("message"), (turn * F.lit(2 * PIECES) + at).alias("seq"), F.lit(kind).alias("kind"), F.col("role").alias("role"), text_.alias("text")
    )
    draft = F.array(
        event("message", F.lit(""), F.lit(0)),
        event("delta", F.reverse(F.substring(text, 1, PIECE)), F.lit(1)),
        event("delta", F.lit(" …"), F.lit(2)),
        event("message", F.lit("and then?"), F.lit(3), F.col("turn").cast("long") + 1, -1 - F.col("message")),
        event("regenerate", F.lit(""), F.lit(4)),
    )
    streamed = F.concat(draft, F.transform(pieces, lambda t, k: event("delta", t, k + 5)))
    edited = F.array(event("message", F.concat(F.lit("oops "), text), F.lit(0)), event("delta", F.lit("!"), F.lit(1)), event("edit", text, F.lit(2)))
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("message", F.monotonically_increasing_id())
    return rows.select("conv_id", F.explode(F.when((F.col("role") == "assistant") & F.col("turn").isNotNull(), streamed).otherwise(edited)).alias("e")).select("conv_id", "e.*")


def part_of(turn: Column) -> Column:
    return F.floor(turn / PART)


def folded(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, turn, message, seq, kind, role, text).

    Events are in order of seq; of events with equal seq, in order of kind and text. A message is one conv_id, turn and
    message, and has the role of its last `message` event; `message`, `edit` and `regenerate` set the text to theirs (null:
    empty), `delta` adds. A `regenerate` drops the messages of later turns that began before it, even where its own was
    dropped meanwhile. A delta, edit or regenerate of a message that has not begun is ignored. Rows that repeat a turn under other message ids stay each.
    Null conversations, turns and messages are groups of their own; no regeneration drops a null turn. An array
    holds one message's events at most. An empty log gives no messages.
    """
    message = ["conv_id", "turn", "message"]
    begins = F.col("kind") == "message"
    sets = F.col("kind").isin("message", "edit", "regenerate")
    e = events.select(*message, "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = e.groupBy(*message).agg(
        F.max(F.when(begins, F.struct("seq", "role"))).alias("begun"),
        F.min(F.when(begins, F.col("seq"))).alias("first"),
        F.max(F.when(sets, F.struct("seq", "kind", "text"))).alias("set"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "text")))).alias("deltas"),
    )
    rows = rows.where("begun IS NOT NULL")
    added = F.transform(F.filter("deltas", lambda x: F.col("set.seq").isNull() | (x["seq"] > F.col("set.seq"))), lambda x: x["text"])
    rows = rows.select(*message[:2], part_of(F.col("turn")).alias("part"), F.col("begun.seq").alias("begun"), F.col("begun.role").alias("role"), F.when(F.col("again") >= F.col("first"), F.col("again")).alias("again"), F.concat(F.col("set.text"), F.array_join(added, "")).alias("text"))
    # the latest regeneration of an earlier turn: of earlier parts, and of earlier turns of the part
    parts = rows.groupBy("conv_id", "part").agg(F.max("again").alias("again"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.max("again").over(earlier).alias("over_part"))
    before = Window.partitionBy("conv_id", "part").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("over", F.max("again").over(before))
    rows = rows.join(parts, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("part").eqNullSafe(F.col("_part")), "left")
    dropped = F.coalesce(F.col("turn").isNotNull() & (F.greatest("over", "over_part") > F.col("begun")), F.lit(False))
    return rows.where(~dropped).select("conv_id", "turn", "role", "text")


def rendered(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss (spans of the assistant texts in formatted, as begin
    and end in code points).

    Turns are in order of turn, then role, then text as formatted; null roles and texts count as empty. A conversation
    is joined in two steps, PART turns first, with the places of texts from running sums, so that what comes together in
    one task is text that is one output row anyway. Equal rows are turns each; an empty table gives no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escaped(role, role=True), F.lit(CLOSE))
    body = escaped(text)
    turns = messages.select(
        "conv_id",
        part_of(F.col("turn")).alias("part"),
        "turn",
        role.alias("role"),
        F.concat(head, body, F.lit(SHUT + "\n")).alias("out"),
        F.char_length(head).cast("long").alias("head"),
        F.char_length(body).cast("long").alias("body"),
    )
    sum_before = lambda what, window: F.coalesce(F.sum(what).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = sum_before(F.char_length("out"), Window.partitionBy("conv_id", "part").orderBy("turn", "role", "out")) + F.col("head")
    turns = turns.withColumn("begin", begin)
    span = F.when(F.col("role") == "assistant", F.struct("begin", (F.col("begin") + F.col("body")).alias("end")))
    part = turns.groupBy("conv_id", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "out"))), lambda x: x["out"]), "").alias("out"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    )
    part = part.withColumn("at", sum_before(F.char_length("out"), Window.partitionBy("conv_id").orderBy("part")))
    part = part.withColumn("spans", F.transform("spans", lambda x: F.struct((x["begin"] + F.col("at")).alias("begin"), (x["end"] + F.col("at")).alias("end"))))
    whole = part.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("part", "out", "spans"))).alias("parts"))
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("parts", lambda p: p["out"]), "").alias("formatted"), F.flatten(F.transform("parts", lambda p: p["spans"])).alias("loss"))


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped."""
    turns = F.filter(F.split(formatted, f"{SHUT}\n"), lambda t: t != "")
    inner = F.transform(turns, lambda t: F.substring(t, F.lit(len(OPEN) + 1), F.char_length(t)))
    return F.transform(inner, lambda t: F.struct(unescaped(F.substring_index(t, CLOSE, 1)).alias("role"), unescaped(F.substring(t, F.locate(CLOSE, t) + 1, F.char_length(t))).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from rendered(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")
    out = formatted.withColumn("turns", read_back(F.col("formatted"))).withColumn("lost", lost)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    return digests(rendered(folded(events_of(rows.unionByName(more)))))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, '<turn:' || replace(replace(replace(replace(role, '\', '\e'), '<turn:', '\o'), '</turn>', '\c'), '>', '\g') || '>'
         || replace(replace(replace(text, '\', '\e'), '<turn:', '\o'), '</turn>', '\c') || '</turn>' || chr(10) AS shown
  FROM c
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(shown))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
