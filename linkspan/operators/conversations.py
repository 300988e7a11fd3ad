"""Stored conversations: a user's conversations, messages in order, masking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.functions.text import mask_ids
from linkspan.operators.spread import number_rows


def messages_of(messages: DataFrame, conversation_id) -> DataFrame:
    """Messages of one conversation by time."""
    return messages.filter(F.col("conversation_id") == conversation_id).orderBy("created_at", "id")


def conversations_of(conversations: DataFrame, user_id) -> DataFrame:
    return conversations.filter(F.col("user_id") == user_id)


def number_messages(messages: DataFrame, group: str, order: str) -> DataFrame:
    """Position of every message in its conversation, from 1."""
    return number_rows(messages, group, order, "position")


def mask_answers(messages: DataFrame, text: str = "text", enabled: bool = True,
                 strategy: str = "mask") -> DataFrame:
    """Hide identity numbers in the answers; what users wrote stays."""
    if not enabled:
        return messages
    return messages.withColumn(
        text, F.when(F.col("role") == "assistant", mask_ids(F.col(text), strategy)).otherwise(F.col(text))
    )
