"""Chat formatting with Spark expressions only.

Turns are collected by conversation as structs and sorted. A block is a run of adjacent turns of one role:

    <|im_start|>role LF text <|im_sep|> text ... <|im_end|> LF

Inside roles and texts, `<`, any number of backslashes and `|` get one more backslash, so a control string can't stand
in a text, and taking one away gives the text back. A line feed in a role is written as `<|nl|>`. The loss mask is run
lengths in code points, in turn true and false, over the formatted text; it covers the assistant's texts.

Defined results: null texts and roles are empty; bytes that aren't UTF-8 are read as U+FFFD; turns are sorted by turn, then role, then text, null turns first, and
repeated rows are turns of their own; rows without a conv_id form one conversation; other columns are ignored; an empty
table gives an empty table. A conversation is one row, so its turns must fit in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agendum.llm.common import text_of

START, SEPARATOR, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _length(text: Column) -> Column:
    return F.length(text).cast("long")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): mask is array<struct<length: long, loss: boolean>> over the code points."""
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(text_of("role"), F.lit("")).alias("role"), F.coalesce(text_of("text"), F.lit("")).alias("text")).alias("t"))
    sorted_ = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        """What stands before the text, the text, and what stands after it; turns of one role are joined."""
        first = (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
        last = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        head = F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
        return F.struct(F.when(first, head).otherwise(F.lit(SEPARATOR)).alias("before"), escaped(t["text"]).alias("text"), F.when(last, F.lit(END)).otherwise(F.lit("")).alias("after"), (t["role"] == LOSS_ROLE).alias("loss"))

    pieces = sorted_.select("conv_id", F.transform("turns", piece).alias("pieces"))
    runs = F.flatten(F.transform("pieces", lambda p: F.array(F.struct(_length(p["before"]).alias("length"), F.lit(False).alias("loss")), F.struct(_length(p["text"]).alias("length"), p["loss"].alias("loss")), F.struct(_length(p["after"]).alias("length"), F.lit(False).alias("loss")))))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    return pieces.select("conv_id", formatted.alias("formatted"), F.filter(runs, lambda r: (r["length"] > 0) | r["loss"]).alias("mask"))


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss): the turns (role, text) and the unescaped texts under the mask, read back."""
    def plain(control: str) -> str:
        return "".join(f"[{c}]" if c in "|<>" else c for c in control)

    blocks = F.filter(F.split("formatted", plain(END)), lambda b: b != "")

    def block(b: Column) -> Column:
        cut = F.instr(b, "\n")
        role = unescaped(F.replace(b.substr(F.lit(len(START) + 1), cut - len(START) - 1), F.lit(LINE), F.lit("\n")))
        body = b.substr(cut + 1, F.length(b))
        return F.transform(F.split(body, plain(SEPARATOR)), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("texts"))

    def step(state: Column, run: Column) -> Column:
        own = F.array(F.col("formatted").substr(state["at"].cast("int"), run["length"].cast("int")))
        return F.struct((state["at"] + run["length"]).alias("at"), F.when(run["loss"], F.concat(state["texts"], own)).otherwise(state["texts"]).alias("texts"))

    under = F.aggregate("mask", start, step, lambda s: F.transform(s["texts"], unescaped))
    return chats.select("conv_id", "formatted", F.flatten(F.transform(blocks, block)).alias("turns"), under.alias("loss"))
