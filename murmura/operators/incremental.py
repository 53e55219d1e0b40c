"""What is still to be done: by watermark, by missing result, or by status.

The watermark mode keeps the reference semantics of dropping rows that arrive late; the anti-join mode, the default, keeps them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def watermarks(results: DataFrame, chat: str = "chat_id", date: str = "date") -> DataFrame:
    """(chat_id, watermark): the latest date of each chat that a result exists for."""
    return results.groupBy(chat).agg(F.max(date).alias("watermark"))


def after_watermark(messages: DataFrame, results: DataFrame, chat: str = "chat_id", date: str = "date") -> DataFrame:
    """Messages later than their chat's watermark, or of chats without one.

    Left to the planner, which broadcasts the watermarks where they are small enough; a null chat has a watermark of its own.
    """
    marks = watermarks(results, chat, date).withColumnRenamed(chat, "_chat")
    joined = messages.join(marks, F.col(chat).eqNullSafe(F.col("_chat")), "left")
    return joined.where(F.col("watermark").isNull() | (F.col(date) > F.col("watermark"))).drop("_chat", "watermark")


def without_result(messages: DataFrame, results: DataFrame, keys: Sequence[str] = ("message_id",)) -> DataFrame:
    """Messages for which no result exists: late ones are found whenever they come."""
    return messages.join(results.select(*keys), list(keys), "left_anti")


def chats_with_new(messages: DataFrame, results: DataFrame, condition, chat: str = "chat_id", date: str = "date") -> DataFrame:
    """(chat_id, watermark) of chats with a row that fits and is later than the watermark, or with no watermark."""
    marks = watermarks(results, chat, date).withColumnRenamed(chat, "_chat")
    latest = messages.where(condition).groupBy(chat).agg(F.max(date).alias("_latest"))
    joined = latest.join(marks, F.col(chat).eqNullSafe(F.col("_chat")), "left")
    return joined.where(F.col("watermark").isNull() | (F.col("_latest") > F.col("watermark"))).select(chat, "watermark")


def in_order(rows: DataFrame, size: int = 0, order: Sequence[str] = ("date", "id")) -> DataFrame:
    """The first rows by date; 0 for all of them."""
    ordered = rows.orderBy(*order)
    return ordered.limit(size) if size else ordered


def page_numbers(rows: DataFrame, size: int, chat: str = "chat_id", order: Sequence[str] = ("date", "id")) -> DataFrame:
    """Number of the page of ``size`` rows that a row is on within its chat.

    Rows are counted by chat and day first, so that a chat with a third of all rows is numbered by many tasks.
    """
    day = F.col(order[0]).cast("date")
    keyed = rows.withColumn("_day", day)
    counts = keyed.groupBy(chat, "_day").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(chat).orderBy(F.asc_nulls_first("_day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    offsets = before.select(F.col(chat).alias("_c"), F.col("_day").alias("_d"), "_before")
    joined = keyed.join(offsets, F.col(chat).eqNullSafe(F.col("_c")) & F.col("_day").eqNullSafe(F.col("_d")))
    number = F.row_number().over(W.partitionBy(chat, "_day").orderBy(*order)) - 1 + F.col("_before")
    return joined.withColumn("page", F.floor(number / size).cast("bigint")).drop("_day", "_c", "_d", "_before")
