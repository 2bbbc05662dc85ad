"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns up to it, of which only that reply is under the loss mask.
A turn is written `<s>role`, a line break, its text, `</s>`.  Control strings inside a text get a backslash after their first
character (one more, if they have some), which `unescaped` takes out again; roles are written URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<s>", "</s>"
# What follows `<` or `[` in a control string.
_REST = r"(/?s>|</?SYS>>|/?INST\])"


def escaped(text: Column) -> Column:
    """The text without any control string."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """The text that `escaped` was given."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def examples(conversations: DataFrame) -> DataFrame:
    """One row per example: (conv_id, n_turns, target, formatted, loss_start, loss_chars).

    conversations: (conv_id, turn, role, text); other columns are ignored.  Turns are ordered by turn, null first, then role
    and text, so ties and repeated rows have one order.  A null role or text counts as empty.  Rows without conv_id belong to
    no conversation and are left out.  `target` counts turns from 1; the loss mask covers `loss_chars` code points of
    `formatted` from `loss_start` (from 1).  Turns after the last reply, or a conversation without one, come as a last example
    with an empty mask, so that every turn is in the output.
    """
    turns = conversations.where("conv_id is not null").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    parts = turns.select(
        "conv_id", F.size("turns").alias("n_turns"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("replies"),
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("turns", lambda t: escaped(t["text"])).alias("bodies"))
    targets = parts.select("*", F.explode(F.filter(
        F.sequence(F.lit(1), F.col("n_turns")), lambda i: (i == F.col("n_turns")) | F.element_at("replies", i))).alias("target"))
    written = F.transform(F.sequence(F.lit(1), F.col("target")), lambda i: F.concat(F.element_at("heads", i), F.element_at("bodies", i), F.lit(CLOSE)))
    reply = F.when(F.element_at("replies", F.col("target")), F.char_length(F.element_at("bodies", F.col("target")))).otherwise(0)
    formatted = targets.select("conv_id", "n_turns", "target", F.array_join(written, "").alias("formatted"), reply.alias("loss_chars"),
                               F.char_length(F.element_at("bodies", F.col("target"))).alias("body"))
    return formatted.select("conv_id", "n_turns", "target", "formatted",
                            (F.char_length("formatted") - len(CLOSE) - F.col("body") + 1).alias("loss_start"), "loss_chars")


def read_turns(formatted: str) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    pieces = F.split(formatted, F.lit(CLOSE), -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        F.url_decode(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
        unescaped(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))


def digests(rows: DataFrame) -> DataFrame:
    """What the examples hold, read back from them: one row per conversation."""
    masked = unescaped(F.substr("formatted", F.col("loss_start"), F.col("loss_chars")))
    whole = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("target", masked.alias("text")))).alias("replies"),
        F.max_by("formatted", "target").alias("last"), F.sum(F.char_length("formatted")).alias("formatted_chars"), F.count("*").alias("n_examples"))
    read = whole.select("conv_id", read_turns("last").alias("turns"), F.array_join("replies.text", "").alias("loss"), "formatted_chars", "n_examples")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
