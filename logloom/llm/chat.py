"""Chat formatting from event logs: logs are folded into final messages, which are rendered with a loss mask.

A log has a row an event: conversation, sequence number, kind, turn, role, text. ``open`` begins a message, ``delta``
appends to it, ``edit`` puts its text in the place of what was there, ``regenerate`` empties a message and withdraws
all later turns, which count again once they are opened anew. Whatever order the rows lie in, the fold goes by
sequence numbers: within a turn only events from its last open, edit or regenerate on make its text, and nothing
logged before an earlier turn was regenerated. Events that share a conversation, turn and number are deliveries of
one; the first by kind, role and text counts. Deltas, edits and regenerations of what isn't open count for nothing.

The template: ``<s>``, then for each turn its mark, a blank, the text and ``</s>``. MARKS has the marks of the common
roles; any other role stands in ``[ROLE]…[/ROLE]``. Within texts and roles a control string gets a backslash after
its first character, one more where it had some, so that none stands there by itself and reading takes one away.
The loss mask is a list of ranges (code points of the formatted text), one for each assistant text.

Everything is DataFrame expressions. Texts of any length are handled in linear time. A message's events, and then a
conversation's turns, come together because one value is made of them; nothing wider does.

Null texts and roles count as empty, a null turn comes first, rows without a conversation are one of their own, and
turns that tie are ordered by role and text. An empty log gives no conversation. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read

BEGIN, END = "<s>", "</s>"
MARKS = {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"}
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
#: A control string with any number of backslashes after its first character.
CONTROL = r"([\[<])(\\*)(/?(?:INST|SYS|ROLE)\]|/?s>)"
ESCAPED = r"([\[<])\\(\\*)(/?(?:INST|SYS|ROLE)\]|/?s>)"
#: Code points of a streamed delta, and of the blocks in which a text is laid out to be cut.
DELTA, BLOCK = 256, 4096


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$2$3")


def blocks(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` code points, the last one shorter; none of an empty text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), 0)


def _once(column: Column) -> Column:
    """The column, worked out once: the optimizer copies nothing that isn't deterministic into a lambda's loop."""
    return F.when(F.spark_partition_id() >= 0, column)


def _whole(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the messages that a log (conv_id, seq, kind, turn, role, text) ends with."""
    event = F.struct("seq", "kind", _whole("role").alias("role"), _whole("text").alias("text"))
    turns = events.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(event)).alias("log"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again")
    )  # the events of one message
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("since", F.max("again").over(earlier))
    first = lambda e, i: (i == 0) | ~F.get("log", i - 1)["seq"].eqNullSafe(e["seq"])
    once = placed.select("conv_id", "turn", _once(F.filter(F.filter("log", first), lambda e: F.col("since").isNull() | (e["seq"] > F.col("since")))).alias("log"))
    opened = once.select("*", _once(F.array_max(F.filter("log", lambda e: e["kind"] == "open"))).alias("opened")).where("opened IS NOT NULL")
    # what stands from the last reset on
    resets = F.filter("log", lambda e: e["kind"].isin("open", "edit", "regenerate") & (e["seq"] >= F.col("opened.seq")))
    based = opened.select("*", _once(F.array_max(F.transform(resets, lambda e: e["seq"]))).alias("base"))
    live = F.filter("log", lambda e: e["seq"] >= F.col("base"))
    return based.select("conv_id", "turn", F.col("opened.role").alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): of messages (conv_id, turn, role, text) the formatted conversation, and the ranges
    (start, n) of its assistants' texts, in order."""
    named = messages.select("conv_id", "turn", _whole("role").alias("role"), _whole("text").alias("text"))
    mark = F.concat(F.lit(ROLE), escaped(F.col("role")), F.lit(ROLE_END))
    for role, own in MARKS.items():
        mark = F.when(F.col("role") == role, own).otherwise(mark)
    marked = named.select("conv_id", "turn", "role", "text", F.concat(mark, F.lit(" ")).alias("mark"), escaped(F.col("text")).alias("inner"))
    sized = marked.select("*", F.char_length("mark").cast("long").alias("head"), F.char_length("inner").cast("long").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum(F.col("head") + F.col("n") + len(END)).over(before)
    placed = sized.select(
        "conv_id", (F.coalesce(size, F.lit(0)) + len(BEGIN)).alias("begin"), F.concat("mark", "inner", F.lit(END)).alias("piece"),
        "head", "n", (F.col("role") == "assistant").alias("learned"),
    )
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("begin", "piece", "head", "n", "learned"))).alias("x"))  # one conversation
    span = lambda t: F.struct((t["begin"] + t["head"]).alias("start"), t["n"].alias("n"))
    return gathered.select(
        "conv_id", F.concat(F.lit(BEGIN), F.array_join(F.transform("x", lambda t: t["piece"]), "")).alias("formatted"),
        F.transform(F.filter("x", lambda t: t["learned"]), span).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, learned): the turns (role, text) of what render gives, and the unescaped texts
    under its loss mask."""
    cut = formatted.select(
        "conv_id", "formatted", "loss", _once(F.split(F.substr("formatted", F.lit(len(BEGIN) + 1)), END, -1)).alias("parts"),
        _once(blocks(F.col("formatted"), BLOCK)).alias("blocks"),
    )

    def turn(part: Column) -> Column:
        at = F.call_function("locate", F.lit(ROLE_END), part)
        role = unescaped(F.substr(part, F.lit(len(ROLE) + 1), at - len(ROLE) - 1))
        text = F.substr(part, at + len(ROLE_END) + 1)
        for name, mark in MARKS.items():
            here = part.startswith(mark + " ")
            role = F.when(here, name).otherwise(role)
            text = F.when(here, F.substr(part, F.lit(len(mark) + 2))).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    def under(span: Column) -> Column:
        first, last = F.floor(span["start"] / BLOCK), F.floor((span["start"] + span["n"]) / BLOCK)
        near = F.array_join(F.slice("blocks", (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return unescaped(F.substr(near, (span["start"] - first * BLOCK + 1).cast("int"), span["n"].cast("int")))

    return cut.select(
        "conv_id", "formatted", F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), turn).alias("turns"), F.transform("loss", under).alias("learned")
    )


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the turns of each conversation counted from 0."""
    rows = conversations.select("conv_id", "turn", _whole("role").alias("role"), _whole("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("turn"), "role", "text")


def logged(messages: DataFrame) -> DataFrame:
    """The log (conv_id, seq, kind, turn, role, text) that numbered messages could have come from. By hashes of ids, some
    messages are streamed straight away, some are edited in the midst, some are regenerated, and in one conversation
    of four a turn is regenerated once all is said, so that what follows it is said again."""
    row = F.col("turn")
    way, redone = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)), F.pmod(F.xxhash64("conv_id"), F.lit(16))
    shaped = messages.select(
        "conv_id", "turn", "role", way.alias("way"), (row - F.when(redone < 4, redone)).alias("beyond"),
        _once(blocks(F.col("text"), DELTA)).alias("said"), _once(blocks(F.concat(F.upper("text"), F.lit(" …")), DELTA)).alias("draft"),
    )

    def event(kind: str, text: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit("").alias("text") if text is None else text.alias("text"))

    def deltas(pieces: Column) -> Column:
        return F.transform(pieces, lambda p: event("delta", p))

    said, draft, opened = F.col("said"), F.col("draft"), F.array(event("open"))
    edited = F.concat(opened, deltas(draft), F.array(event("edit", F.coalesce(F.get(said, F.lit(0)), F.lit("")))), deltas(F.slice(said, F.lit(2), F.greatest(F.size(said), F.lit(1)))))
    again = F.concat(opened, deltas(draft), F.array(event("regenerate")), deltas(said))
    straight = F.concat(opened, deltas(said))
    none = F.slice(straight, F.lit(1), F.lit(0))
    before = F.when(F.col("beyond") >= 0, F.concat(opened, deltas(draft))).when(F.col("way") == 1, edited).when(F.col("way") == 2, again).otherwise(straight)
    after = F.when(F.col("beyond") == 0, F.concat(F.array(event("regenerate")), deltas(said))).when(F.col("beyond") > 0, straight).otherwise(none)
    parts = [
        shaped.select("conv_id", "turn", "role", F.posexplode(events).alias("step", "e"), F.lit(attempt).alias("attempt"))
        for attempt, events in enumerate((before, after))
    ]
    return parts[0].unionByName(parts[1]).select(
        "conv_id", (F.col("attempt") * F.lit(1 << 62) + row * F.lit(1 << 31) + F.col("step")).alias("seq"), F.col("e.kind").alias("kind"), "turn", "role", F.col("e.text").alias("text")
    )


def op12_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, logged, folded, rendered and read back."""
    said = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_back(render(fold(logged(numbered(rows.unionByName(own))))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(lines).alias("turns_sha256"), F.char_length(learned).cast("long").alias("loss_chars"),
        digest(learned).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
