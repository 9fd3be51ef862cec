"""First user turns of a stream of conversation turns (A2, B1): a streaming aggregation in update mode.

Every turn carries its conversation's start time. The state of a conversation is one row (the smallest
user turn so far, its text, the number of turns); it is dropped when the watermark passes the start
time, so the state is bounded by the conversations of the last ``late`` time, not by the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.functions.text import strip_text
from cachelens.streaming.lookup_stream import run_updates_to_table


def first_user_turn_updates(turns: DataFrame, start_col: str, late: str = "1 day", conv_col: str = "conv_id", turn_col: str = "turn",
                            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(started, conv, first_turn, first_text, num_turns)``, a new row whenever a conversation changes. The first
    user turn is the one with the smallest number, in whatever order the turns arrive."""
    user = F.col(role_col) == "user"
    number = F.when(user, F.col(turn_col))
    return (turns.withWatermark(start_col, late).groupBy(F.col(start_col).alias("started"), F.col(conv_col).alias("conv"))
            .agg(F.min(number).alias("first_turn"), F.min_by(F.col(text_col), number).alias("first_text"), F.count(F.lit(1)).alias("num_turns")))


def first_user_turns(turns: DataFrame, start_col: str, late: str = "1 day", **columns) -> DataFrame:
    """The stream run over what is there: the columns of ``operators.text.first_user_turn_flat``. Conversations without a
    user turn, or with a blank first one, are left out."""
    rows = run_updates_to_table(first_user_turn_updates(turns, start_col, late, **columns), "first-turns", ["started", "conv"])
    return rows.filter("first_turn IS NOT NULL").select(
        F.col("conv").cast("long").alias("query_id"), strip_text(F.col("first_text")).alias("query_text"), F.col("conv").cast("long").alias("original_index"),
        F.col("num_turns").cast("int").alias("num_turns"), F.col("conv").cast("string").alias("conversation_id")).filter(F.length("query_text") > 0)
