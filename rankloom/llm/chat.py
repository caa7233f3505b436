"""Prefix-target expansion of conversations: every assistant turn is an example of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import exact_cumsum

OPEN, CLOSE = "###", "</turn>"
#: Turns that are sorted together.
TURNS = 512


def escape(text: Column) -> Column:
    """Control strings can't occur in the result; ``unescape`` gives the text back."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.replace(text, F.lit(CLOSE), F.lit("\\e"))
    return F.replace(text, F.lit(OPEN), F.lit("\\h"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\h"), F.lit(OPEN))
    text = F.replace(text, F.lit("\\e"), F.lit(CLOSE))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def format_turns(turns: DataFrame, target_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn, with its place in the formatted conversation: the layout that ``render_examples`` expands.

    A turn reads ``### role:`` newline, text, newline, ``</turn>`` newline; texts and roles are escaped. The
    formatted conversation is the segments joined in order. A target turn becomes an example: its context is
    the first ``context_chars`` code points of the formatted conversation, all preceding turns, and only code
    points from ``loss_start`` to ``loss_end``, the reply, are trainable.

    Null texts and roles are empty. Turns go by number, null first; turns of one number by role and text.
    Null conversation ids are one conversation. A very long conversation is laid out by several tasks.

    Returns conv_id, turn, segment, seg_start, seg_end, is_target, context_chars, loss_start, loss_end, conv and
    part (the keys by which turns lie together, never null) and formatted_chars (of the conversation).
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(f"{OPEN} "), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit(":\n"))
    body = escape(F.col("text"))
    rows = rows.select(
        "conv_id",
        "turn",
        (F.col("role") == target_role).alias("is_target"),
        F.char_length(head).alias("head"),
        F.char_length(body).alias("body"),
        F.concat(head, body, F.lit(f"\n{CLOSE}\n")).alias("segment"),
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("conv"),
        F.coalesce(F.expr(f"turn div {TURNS}"), F.lit(-(2**62))).alias("part"),
    )
    order = [F.col("turn"), F.col("segment")]
    rows = exact_cumsum(rows, ["conv"], "part", order, F.char_length("segment"), "seg_start")
    start = F.col("seg_start") + F.col("head")
    target = lambda c: F.when(F.col("is_target"), c)
    return rows.select(
        "conv_id",
        "turn",
        "segment",
        "seg_start",
        (F.col("seg_start") + F.char_length("segment")).alias("seg_end"),
        "is_target",
        target(F.col("seg_start")).alias("context_chars"),
        target(start).alias("loss_start"),
        target(start + F.col("body")).alias("loss_end"),
        "conv",
        "part",
        F.col("seg_start_total").alias("formatted_chars"),
    )


def render_examples(formatted: DataFrame, rest: bool = False) -> DataFrame:
    """Prefix-target expansion: a row per target turn, ``example``, which is its whole context and the turn, written out.

    ``loss_start`` to ``loss_end`` are the code points of the example under the loss mask; ``ends`` tells that nothing follows
    in the conversation. With ``rest`` a conversation that doesn't end with a target has one more row, all of it without loss, so
    that every turn is in some row.

    Turns are gathered in parts of TURNS turns, later parts get the text of the parts before them, and each part's examples are
    written by one task, so those of a long conversation are written by several. The output is as long as all contexts
    together, which for one conversation grows with the square of its length.

    Returns conv_id, turn, example, loss_start, loss_end, ends.
    """
    turn = F.struct("seg_start", "seg_end", "turn", "is_target", "loss_start", "loss_end", "segment")
    parts = formatted.groupBy("conv", "part", "conv_id", "formatted_chars").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    ends = lambda t: t["seg_end"] == F.col("formatted_chars")
    shown = F.filter("turns", lambda t: t["is_target"] | ends(t) if rest else t["is_target"])
    kept = F.transform(shown, lambda t: F.struct(t["turn"].alias("turn"), t["seg_end"].alias("seg_end"), t["loss_start"].alias("loss_start"), t["loss_end"].alias("loss_end"), ends(t).alias("ends")))
    parts = parts.select("conv", "part", "conv_id", "formatted_chars", F.array_join("turns.segment", "").alias("text"), kept.alias("turns"))
    # Most conversations are one part and stay where they are.
    alone = F.char_length("text") == F.col("formatted_chars")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    long = parts.where(~alone).withColumn("text", F.concat(F.array_join(F.collect_list("text").over(earlier), ""), "text")).where(F.size("turns") > 0)
    parts = parts.where(alone).unionByName(long.repartition("conv", "part"))
    rows = parts.select("conv_id", "text", F.explode("turns").alias("t"))
    example = F.substring("text", F.lit(1), F.col("t.seg_end").cast("int"))
    return rows.select("conv_id", "t.turn", example.alias("example"), "t.loss_start", "t.loss_end", "t.ends")


def read_examples(examples: DataFrame) -> DataFrame:
    """What written examples hold: conv_id, loss_start, loss_text (the text under the mask) and whole (the example that ends the conversation)."""
    masked = F.substring(F.col("example"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return examples.select("conv_id", "loss_start", unescape(masked).alias("loss_text"), F.when(F.col("ends"), F.col("example")).alias("whole"))


def role_of(segment: Column) -> Column:
    """The role that a segment's first line names."""
    head = F.substring_index(segment, ":\n", 1)
    return unescape(F.replace(F.substring(head, len(OPEN) + 2, 2**31 - 1), F.lit("\\n"), F.lit("\n")))


def turns_of(text: Column) -> Column:
    """An array of (role, text) read from formatted turns; no control string is left in a text, so turns end where CLOSE stands."""
    pieces = F.split(text, f"\n{CLOSE}\n", -1)
    body = lambda p: F.substring(p, F.char_length(F.substring_index(p, ":\n", 1)) + 3, F.char_length(p))
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(role_of(p).alias("role"), unescape(body(p)).alias("text")))


def read_turns(formatted: DataFrame) -> DataFrame:
    """Roles and texts read back from segments, with the text under the loss mask (null where there is none)."""
    head, role = F.substring_index("segment", ":\n", 1), role_of(F.col("segment"))
    tail = len(CLOSE) + 2
    text = F.substring(F.col("segment"), F.char_length(head) + 3, F.char_length("segment") - F.char_length(head) - 2 - tail)
    masked = F.substring(F.col("segment"), (F.col("loss_start") - F.col("seg_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return formatted.select("conv_id", "turn", "seg_start", "seg_end", role.alias("role"), unescape(text).alias("text"), unescape(masked).alias("loss_text"))
