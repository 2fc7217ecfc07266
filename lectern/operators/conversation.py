"""Sliding conversation buffer over (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.config import DEFAULT
from lectern.functions.text import truncate
from lectern.operators.skew import last_rows_per_key


def buffered(messages: DataFrame, max_turns: int = DEFAULT.memory_turns) -> DataFrame:
    """The last ``2 * max_turns`` messages of each conversation; none for zero turns."""
    if max_turns <= 0:
        return messages.limit(0)
    return last_rows_per_key(messages, ["conv_id"], "turn", 2 * max_turns)


def message_line(role: Column, text: Column, max_chars: int = DEFAULT.memory_chars) -> Column:
    who = F.when(role == "user", F.lit(V.USER_LABEL)).otherwise(F.lit(V.ASSISTANT_LABEL))
    return F.concat(who, F.lit(": "), truncate(text, max_chars, "..."))


def history_text(
    messages: DataFrame, max_turns: int = DEFAULT.memory_turns, max_chars: int = DEFAULT.memory_chars
) -> DataFrame:
    """One prompt text per conversation; the buffer bounds what is collected for it."""
    kept = buffered(messages, max_turns).select(
        "conv_id", "turn", message_line(F.col("role"), F.col("text"), max_chars).alias("line")
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn", "line")))
    lines = F.transform(ordered, lambda m: m["line"])
    return kept.groupBy("conv_id").agg(
        F.array_join(F.concat(F.array(F.lit(V.HISTORY_TITLE)), lines), "\n").alias("history")
    )


def turn_counts(messages: DataFrame, max_turns: int | None = None) -> DataFrame:
    """Length of each conversation in turns (two messages make one), of the buffer if limited."""
    n = F.count("*")
    if max_turns is not None:
        n = F.least(n, F.lit(2 * max_turns))
    return messages.groupBy("conv_id").agg(F.floor(n / 2).cast("long").alias("turns"))
