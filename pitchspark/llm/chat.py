"""Chat formatting (10): prefix-target expansion. DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Reversible escapes, applied in this order and undone in reverse: afterwards no text holds "<|", no role a line break.
ESCAPES = [("\\", "\\s"), ("<|", "<\\p|"), ("\n", "\\l")]


def escaped(c: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES[: 3 if role else 2]:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, role: bool = False) -> Column:
    for plain, code in reversed(ESCAPES[: 3 if role else 2]):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def chat_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, n_turns, text, loss_start, loss_end: an example for every assistant turn.

    An example holds all turns up to that one; its loss mask covers the reply alone: code points
    [loss_start, loss_end) of the text. Turns after the last reply, or all of a conversation without one,
    make a last example with an empty mask, so every turn is in the output. Turns sort by turn, then role
    and text, so ties and repeated rows stay and have one order. Null roles and texts are empty. Rows with
    a null conv_id are one conversation. An empty table gives no examples; other columns are ignored.

    A conversation is one row of one task, and its examples grow with the square of its turns: that is what the expansion
    writes. Very long texts are formatted within their row.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("turn"), blank("role").alias("role"), blank("text").alias("text")))).alias("turns"))
    formatted = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == "assistant").alias("reply"),
            F.concat(F.lit(START), escaped(t["role"], role=True), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
        ),
    )
    ends = F.filter(F.transform("f", lambda t, i: F.when(t["reply"] | (i == F.size("f") - 1), i)), lambda i: i.isNotNull())
    rows = turns.select("conv_id", formatted.alias("f")).select("conv_id", "f", F.posexplode(ends).alias("example", "last"))
    turn_text = lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))
    before = F.concat(_joined(F.transform(F.slice("f", 1, F.col("last")), turn_text)), F.get("f", F.col("last"))["head"])
    rows = rows.select("conv_id", "example", "last", before.alias("before"), F.get("f", F.col("last")).alias("t"))
    start = F.length("before").cast("long")
    return rows.select(
        "conv_id",
        "example",
        (F.col("last") + 1).cast("long").alias("n_turns"),
        F.concat("before", "t.body", F.lit(END + "\n")).alias("text"),
        start.alias("loss_start"),
        F.when(F.col("t.reply"), start + F.length("t.body")).otherwise(start).alias("loss_end"),
    )


def parse_turns(text: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    chunks = F.filter(F.split(text, r"<\|im_start\|>"), lambda c, i: i > 0)
    body = lambda c: F.substring(c, F.instr(c, "\n") + 1, F.length(c) - F.instr(c, "\n") - F.length(F.lit(END + "\n")))
    return F.transform(chunks, lambda c: F.struct(unescaped(F.substring_index(c, "\n", 1), role=True).alias("role"), unescaped(body(c)).alias("text")))


def chat_digest(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the examples."""
    loss = unescaped(F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    read = examples.select("conv_id", "example", "text", loss.alias("loss"), F.length("text").cast("long").alias("chars"))
    by = read.groupBy("conv_id").agg(F.max_by("text", "example").alias("text"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"))
    turns = by.select("conv_id", parse_turns(F.col("text")).alias("turns"), _joined(F.col("losses.loss")).alias("loss"), "formatted_chars")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(_joined(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
