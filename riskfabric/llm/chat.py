"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example holds all turns up to and including its target; only the text of the target is trainable. Turns are marked with control
strings, and every control string inside a role or text is escaped reversibly, so a text can never open or close a turn.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# The strings that chat templates read as control.
CONTROL = (START, SEPARATOR, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

# A backslash goes after every backslash and after the first character of every control string.
_TO_ESCAPE = r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
_ESCAPED = r"([\\<\[])\\"


def escape(text: Column) -> Column:
    """Text without any control string; `unescape` gives the text back."""
    return F.regexp_replace(text, _TO_ESCAPE, "$0\\\\")


def unescape(text: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(text, _ESCAPED, "$1")


def prefix_examples(conversations: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text",
                    target: str = "assistant", tail: bool = True) -> DataFrame:
    """One row per target turn: conversation, `position` of the target, `n_turns`, `formatted`, `loss_start`, `loss_chars`, `trainable`, `whole`.

    `loss_start` and `loss_chars` are code points of `formatted` and cover the escaped text of the target alone. `whole` marks the example
    that holds the entire conversation; with `tail` a conversation that does not end in a target turn gets one more row for it without
    trainable text. Turns are ordered by `order`, ties by role and text, missing orders first. A missing role or text is empty; rows without
    a conversation id form one conversation. Repeated rows are repeated turns. An empty table gives no rows. Other columns are not read.

    The turns of a conversation meet once; expanding and reading back need no other shuffle.
    """
    body = escape(F.coalesce(F.col(text).cast("string"), F.lit("")))
    name = F.coalesce(F.col(role).cast("string"), F.lit(""))
    turn = F.struct(F.col(order).alias("at"), name.alias("who"), body.alias("body"))
    talks = conversations.select(F.col(conversation), turn.alias("_turn")).groupBy(conversation).agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    line = lambda x: F.concat(F.lit(START), escape(x["who"]), F.lit(SEPARATOR), x["body"], F.lit(END))
    talks = talks.select(conversation, F.transform("_turns", lambda x: F.struct(line(x).alias("line"), (x["who"] == target).alias("target"),
                                                                                F.char_length(x["body"]).alias("chars"))).alias("_turns"))
    last = F.size("_turns") - 1
    stops = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("_turns", i)["target"] | (F.lit(tail) & (i == last)))
    talks = talks.select(conversation, "_turns", last.alias("_last"), F.explode(stops).alias("position"))
    formatted = F.array_join(F.transform(F.slice("_turns", F.lit(1), F.col("position") + 1), lambda x: x["line"]), "")
    stop = F.get("_turns", F.col("position"))
    cut = talks.select(conversation, "position", (F.col("position") + 1).cast("long").alias("n_turns"), formatted.alias("formatted"),
                       stop["target"].alias("trainable"), F.when(stop["target"], stop["chars"]).otherwise(0).cast("long").alias("loss_chars"),
                       (F.col("position") == F.col("_last")).alias("whole"))
    start = F.char_length("formatted") - len(END) - F.col("loss_chars")
    return cut.withColumn("loss_start", F.when(F.col("trainable"), start).otherwise(0).cast("long"))


def trained_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The unescaped text under an example's loss mask."""
    return unescape(F.substr(formatted, start.cast("int") + 1, chars.cast("int")))


def parse(formatted: Column) -> Column:
    """Turns of a formatted example as an array of (role, text)."""
    cut = lambda line: F.split(F.substr(line, F.lit(len(START) + 1)), re.escape(SEPARATOR), -1)
    lines = F.filter(F.split(formatted, re.escape(END), -1), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(unescape(cut(x)[0]).alias("role"), unescape(cut(x)[1]).alias("text")))
