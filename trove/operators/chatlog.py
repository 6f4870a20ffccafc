"""Conversation look-ups for many users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.operators.ranking import places, top_k

BLOCK_TURNS = 1000


def history_by_user(df: DataFrame, user_col: str, time_col: str, id_col: str) -> DataFrame:
    """Each user's rows with their ``place``, newest first; a row without a
    user is nobody's.

    Rows are ranked by ranges of user and time, so that no task has to sort the
    whole history of a busy user, even if all of it fell on one instant.
    """
    rows = df.where(F.col(user_col).isNotNull())
    found = places(rows, user_col, [F.desc(time_col), F.desc(id_col)])
    return found.withColumn("place", F.col("place") + 1)


def newest(df: DataFrame, user_col: str, time_col: str, id_col: str, limit: int) -> DataFrame:
    """Only the ``limit`` newest rows per user; tasks cut before the shuffle."""
    order = [F.desc(time_col), F.desc(id_col)]
    return top_k(df.where(F.col(user_col).isNotNull()), limit, user_col, order)


def owned(df: DataFrame, requests: DataFrame, id_col: str, user_col: str) -> DataFrame:
    """Rows a request names by key and that belong to the asking user."""
    return df.join(requests.select(id_col, user_col).distinct(), [id_col, user_col])


def nest_messages(
    df: DataFrame, chat_col: str, order_col: str, fields: list[str], block_turns: int = BLOCK_TURNS
) -> DataFrame:
    """``(chat, block, messages, n_messages)``: a chat with its ordered messages.

    A chat is one row, block 0, up to ``block_turns`` turns; a longer one goes
    on in further blocks, so no array outgrows a task.
    """
    block = F.floor(F.col(order_col) / block_turns).alias("block")
    return df.groupBy(chat_col, block).agg(
        F.array_sort(F.collect_list(F.struct(order_col, *fields))).alias("messages"),
        F.count(F.lit(1)).alias("n_messages"),
    )
