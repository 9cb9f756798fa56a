"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events ``(conv_id, seq, message, kind, role, text)``:

    open        starts a message with a role and perhaps a first text
    delta       appends text to it (streamed output)
    edit        replaces its text
    regenerate  throws its text away; later deltas build it anew
    delete      removes it

``fold`` reconstructs the final messages, ``render`` writes each as a turn
between control strings, and ``format_conversations`` joins the turns of a
conversation into one string with a loss mask; ``parse`` reads the turns back.
All of it is grouping and array expressions.  Events meet per message, turns
per block of ``BLOCK`` turns, and only finished blocks per conversation, so a
conversation that holds much of the table is spread over many tasks.

Template: a user turn is ``[INST] text [/INST]``, an assistant turn
``<s> text </s>``, a system turn ``<<SYS>> text <</SYS>>``; any other role is
``[ROLE] role [TEXT] text [/ROLE]``.  Each ``<``, ``[`` or backslash inside a
role or text is followed by a backslash, which breaks every control string
and is undone by reading from the left.

Nulls and edge cases: a null text is empty; a null role is a role with an
empty name; a null conv_id is a conversation of its own; a null turn or seq
comes first; events of a message that was never opened are void; rows that
tie on their turn are ordered by role and text, and identical rows are
separate turns; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256

OPENING = {"user": "[INST] ", "assistant": "<s> ", "system": "<<SYS>> "}
CLOSING = {"user": " [/INST]", "assistant": " </s>", "system": " <</SYS>>"}
OTHER, BETWEEN, END = "[ROLE] ", " [TEXT] ", " [/ROLE]"
TURN_STARTS = r"(?=\[INST\] |<s> |<<SYS>> |\[ROLE\] )"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def events_of(turns: DataFrame) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text): each
    opens its message and streams its text as one delta."""
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select("conv_id", "turn", F.col("role"), F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("tie", F.row_number().over(order))
    message = F.struct(F.col("turn"), F.col("tie"))
    both = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("open").alias("kind"), F.col("role").alias("role"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("step"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.col("text").alias("text")))
    return rows.select("conv_id", "turn", "tie", message.alias("message"), F.explode(both).alias("e")) \
        .select("conv_id", F.struct("turn", "tie", "e.step").alias("seq"), "message", "e.kind", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, position (seq of its opening), role, text."""
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    opening = F.filter("log", lambda e: e.kind == "open")
    resets = F.transform(F.filter("log", lambda e: e.kind.isin("open", "edit", "regenerate")), lambda e: e.seq)
    log = log.withColumns({"opening": F.get(opening, F.lit(0)), "reset": F.get(F.reverse(resets), F.lit(0))})
    live = F.filter("log", lambda e: (e.seq >= F.col("reset")) & (e.kind != "regenerate"))
    return log.where(F.col("opening").isNotNull() & ~F.exists("log", lambda e: e.kind == "delete")).select(
        "conv_id", "message", F.col("opening.seq").alias("position"),
        F.coalesce("opening.role", F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e.text), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Messages with ``piece``, the formatted turn, and the part of it under
    the loss mask: ``mask_start`` (code points into the piece) and
    ``mask_length`` (0 unless an assistant speaks)."""
    role, text = F.col("role"), escape(F.col("text"))

    def by_role(given: dict[str, str], other: Column) -> Column:
        out = other
        for name, s in given.items():
            out = F.when(role == name, F.lit(s)).otherwise(out)
        return out

    opening = by_role(OPENING, F.concat(F.lit(OTHER), escape(role), F.lit(BETWEEN)))
    return messages.withColumns({
        "piece": F.concat(opening, text, by_role(CLOSING, F.lit(END))),
        "mask_start": F.length(opening).cast("long"),
        "mask_length": F.when(role == "assistant", F.length(text)).otherwise(0).cast("long"),
    })


def _starts(lengths: Column) -> Column:
    """Running sums before each element of a short array."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(lengths, zero, lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def join_turns(pieces: DataFrame, block: Column) -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns and ``turns``, an
    array of (start, mask_start, mask_length) in code points of formatted."""
    turn = F.struct("position", "piece", "mask_start", "mask_length")
    blocks = pieces.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(turn)).alias("own"))
    blocks = blocks.withColumn("starts", _starts(F.transform("own", lambda t: F.length(t.piece).cast("long"))))
    spans = F.zip_with("own", F.slice("starts", 1, F.size("own")), lambda t, s: F.struct(
        s.alias("start"), (s + t.mask_start).alias("mask_start"), t.mask_length.alias("mask_length")))
    blocks = blocks.select(
        "conv_id", F.col("own")[0]["position"].alias("first"), F.array_join(F.transform("own", lambda t: t.piece), "").alias("text"),
        F.element_at("starts", -1).alias("length"), spans.alias("spans"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "text", "length", "spans"))).alias("own"))
    whole = whole.withColumn("starts", _starts(F.transform("own", lambda b: b.length)))
    moved = F.zip_with("own", F.slice("starts", 1, F.size("own")), lambda b, s: F.transform(b.spans, lambda t: F.struct(
        (t.start + s).alias("start"), (t.mask_start + s).alias("mask_start"), t.mask_length.alias("mask_length"))))
    return whole.select("conv_id", F.array_join(F.transform("own", lambda b: b.text), "").alias("formatted"),
                        F.flatten(moved).alias("turns")).withColumn("n_turns", F.size("turns").cast("long"))


def format_conversations(events: DataFrame, turn_number: Column) -> DataFrame:
    """Fold, render and join a log.  ``turn_number`` (an integer expression of
    ``position``) rises with the position; it only says which turns share a block."""
    block = F.coalesce(F.floor(turn_number / BLOCK), F.lit(-1))
    return join_turns(render(fold(events)), block)


def parse(formatted: DataFrame) -> DataFrame:
    """Formatted rows with ``parsed``: an array of (role, text, masked), read
    back from ``formatted`` and the spans of ``turns`` alone.  ``masked`` is
    the text under the loss mask, empty for turns without."""
    pieces = F.filter(F.split("formatted", TURN_STARTS), lambda p: p != "")

    def between(p: Column, opening: str, closing: str) -> Column:
        return F.substring(p, F.lit(len(opening) + 1), F.length(p) - len(opening) - len(closing))

    def role_of(p: Column) -> Column:
        out = unescape(F.substring_index(F.substring(p, F.lit(len(OTHER) + 1), F.length(p)), BETWEEN, 1))
        for name, opening in OPENING.items():
            out = F.when(p.startswith(opening), F.lit(name)).otherwise(out)
        return out

    def text_of(p: Column) -> Column:
        out = F.substring(p, F.instr(p, BETWEEN) + len(BETWEEN), F.length(p) - F.instr(p, BETWEEN) - len(BETWEEN) + 1 - len(END))
        for name, opening in OPENING.items():
            out = F.when(p.startswith(opening), between(p, opening, CLOSING[name])).otherwise(out)
        return unescape(out)

    def read(p: Column, t: Column) -> Column:
        masked = F.substring(p, (t.mask_start - t.start + 1).cast("int"), t.mask_length.cast("int"))
        return F.struct(role_of(p).alias("role"), text_of(p).alias("text"), unescape(masked).alias("masked"))

    return formatted.withColumn("parsed", F.zip_with(pieces, "turns", read))
