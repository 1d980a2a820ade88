"""Preference formatting: one prompt, two masked completions.

The longest common prefix of turns of a chosen and a rejected conversation is
rendered once, as the prompt; what follows in either becomes its completion, with
the character spans that a loss may see: those of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TURN = "struct<turn:bigint,role:string,text:string>"


def turn_list(df: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key, turns``: a conversation's turns in order.

    Null roles and texts count as empty.  Turns are ordered by number (null
    first), then role, then text; a row that repeats another exactly is one turn.
    """
    one = F.struct(
        F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    return df.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(one)).alias("turns"))


def _said(turn: Column) -> Column:
    return F.struct(turn["role"], turn["text"])


def rendered(turn: Column) -> Column:
    """A turn as text."""
    return F.concat(F.lit(OPEN), turn["role"], F.lit(SEP), turn["text"], F.lit(CLOSE))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading turns that two conversations share, by role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.transform(a, _said), F.transform(b, _said), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)  # 1-based; 0 if there is none
    return F.when(at == 0, n).otherwise(F.least(n, (at - 1).cast("int")))


def _completion(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _loss_spans(turns: Column) -> Column:
    """``start:end`` character spans of the assistant's texts with their closing mark, comma-joined."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(turn["role"]) + len(OPEN) + len(SEP)
        end = begin + F.length(turn["text"]) + len(CLOSE)
        span = F.concat(F.when(state["spans"] == "", F.lit("")).otherwise(F.lit(",")), begin.cast("string"), F.lit(":"), end.cast("string"))
        spans = F.concat(state["spans"], F.when(turn["role"] == "assistant", span).otherwise(F.lit("")))
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda state: state["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """Format the conversations that have a chosen and a rejected form.

    Both inputs hold ``key, turn, role, text``; other columns are not read.
    Returns ``key``, ``n_prompt_turns``, ``prompt``, and for either side its
    ``completion`` and ``loss`` spans (``start:end``, counted in the completion).
    Keys that only one side has, and null keys, give no row; where both sides are
    equal both completions are empty; an empty table gives no rows.  Turns of any
    length are kept whole.  A conversation is one output row, so its turns meet in
    one task; nothing larger does.
    """
    c, r = turn_list(chosen, key).withColumnRenamed("turns", "c"), turn_list(rejected, key).withColumnRenamed("turns", "r")
    both = c.join(r, "key").withColumn("n", common_prefix(F.col("c"), F.col("r")))
    n = F.col("n")
    rest = {side: F.slice(F.col(side), n + 1, F.greatest(F.size(side) - n, F.lit(0))) for side in "cr"}
    return both.select(
        F.col("key").alias(key),
        n.alias("n_prompt_turns"),
        _completion(F.slice(F.col("c"), F.lit(1), n)).alias("prompt"),
        _completion(rest["c"]).alias("chosen"),
        _loss_spans(rest["c"]).alias("chosen_loss"),
        _completion(rest["r"]).alias("rejected"),
        _loss_spans(rest["r"]).alias("rejected_loss"),
    )


def repeating_answers(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """A rejected form of each conversation: every later answer repeats the first one."""
    turns = Window.partitionBy(key).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answer = F.when(F.col("role") == "assistant", F.coalesce("text", F.lit("")))
    first = F.first(answer, ignorenulls=True).over(turns)
    return conversations.select(key, "turn", "role", F.when(F.col("role") == "assistant", first).otherwise(F.col("text")).alias("text"))
