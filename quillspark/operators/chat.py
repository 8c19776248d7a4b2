"""Conversations: the window of history, titles, and undoing an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY, STORED, TITLE = 10, 100, 50


def history(messages: DataFrame, last: int = HISTORY) -> DataFrame:
    """The last messages of user and assistant of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.where(F.col("role").isin("user", "assistant")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last).drop("_r")


def stored(messages: DataFrame, last: int = STORED) -> DataFrame:
    """The last messages of each conversation, of any role."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last).drop("_r")


def without_last_answer(messages: DataFrame) -> DataFrame:
    """Without the last message of each conversation where that is the assistant's."""
    last = messages.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn")).where("role = 'assistant'")
    return messages.join(last.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")


def titles(messages: DataFrame) -> DataFrame:
    """conv_id and title: the start of the first message of the user."""
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", F.substring("text", 1, TITLE).alias("title"))
