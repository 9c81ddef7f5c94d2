"""Chat formatting by prefix-target expansion, DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and its own text as the only
trainable span.  A conversation that doesn't end with an assistant turn gives one more example, of all its turns
with nothing to train on, so that no turn is lost.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts ``\\`` becomes ``\\b`` and ``<|``
becomes ``<\\l``, and inside roles a newline ``\\n``: no control string is left, and ``unescape`` gives the original back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (index of the target turn, from 0), n_turns (in the example), formatted, loss_start, loss_chars.

    ``formatted`` holds the loss span at code points ``loss_start`` to ``loss_start + loss_chars``; an example without
    target has a span of 0 at its end.  Turns are ordered by turn (null first), then role and text; null roles and
    texts count as empty; rows that repeat are turns of their own; a null conv_id is a conversation like any other.
    Other columns are not read; an empty table gives no examples.
    """
    turns = conversations.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                                                     F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    last = F.size("turns") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("turns", i)["role"] == "assistant") | (i == last))
    shown = F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END)))
    each = talks.select("conv_id", "turns", shown.alias("shown"), targets.alias("targets")) \
        .select("conv_id", "turns", "shown", F.explode("targets").alias("example"))
    # the target's text is the end of its turn but for the closing mark
    target = F.get("turns", F.col("example"))
    trained = F.when(target["role"] == "assistant", F.length(escape(target["text"]))).otherwise(F.lit(0))
    made = each.select("conv_id", "example", (F.col("example") + 1).alias("n_turns"),
                       F.array_join(F.slice("shown", F.lit(1), F.col("example") + 1), "").alias("formatted"), trained.alias("loss_chars"),
                       (target["role"] == "assistant").alias("_trains"))
    return made.select("conv_id", "example", "n_turns", "formatted",
                       F.when(F.col("_trains"), F.length("formatted") - len(END) - F.col("loss_chars")).otherwise(F.length("formatted")).alias("loss_start"),
                       "loss_chars")


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns (of role and text), losses (the unescaped loss texts in order), formatted_chars, from the examples alone."""
    loss = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_chars")))
    got = examples.select("conv_id", "example", "formatted", loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    talks = got.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("longest"),
                                       F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
                                       F.sum("chars").alias("formatted_chars"))
    parts = F.filter(F.split("longest", r"<\|im_end\|>\n"), lambda x: x != "")
    turns = F.transform(parts, lambda x: F.struct(
        unescape(F.substring_index(F.replace(x, F.lit(START), F.lit("")), "\n", 1)).alias("role"),
        unescape(F.substring(x, F.locate("\n", x) + 1, F.length(x))).alias("text")))
    return talks.select("conv_id", turns.alias("turns"), F.transform("losses", lambda x: x["loss"]).alias("losses"), "formatted_chars")
