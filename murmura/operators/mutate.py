"""Nested partial updates as rewrites of a table: the result is the new table, writing it is the caller's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.schemas import CLASSIFICATION

#: What transcription adds to an attachment.
TRANSCRIPTION_FIELDS = ("transcription", "transcription_status", "transcription_language", "transcription_language_probability")


def set_struct(messages: DataFrame, results: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Put ``results.column`` into the rows of the same key; rows without a result keep theirs, results without a row are dropped."""
    new = results.select(F.col(key).alias("_key"), F.col(column).alias("_new"))
    joined = messages.join(new, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(column, F.coalesce("_new", column)).select(*messages.columns)


def merge_fields(messages: DataFrame, results: DataFrame, column: str, fields: Sequence[str], key: str = "id") -> DataFrame:
    """Deep merge: set ``fields`` of a struct from results that have them; other fields stay, and no struct appears where none was.

    A result's field that is null is left as it was (absent in the update).
    """
    new = results.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = messages.join(new, F.col(key) == F.col("_key"), "left")
    value = F.col(column)
    for f in fields:
        value = value.withField(f, F.coalesce(F.col(f"_new_{f}"), F.col(column)[f]))
    return joined.withColumn(column, value).select(*messages.columns)


def _nulled(struct: Column, table: DataFrame, column: str, fields: Sequence[str]) -> Column:
    for f in fields:
        struct = struct.withField(f, F.lit(None).cast(table.schema[column].dataType[f].dataType))
    return struct


def clear_fields(messages: DataFrame, column: str = "attachment", fields: Sequence[str] = TRANSCRIPTION_FIELDS, where: str = "attachment.transcription_status is not null") -> DataFrame:
    """Take fields of a struct back to null in the rows of a condition; a null struct stays null."""
    return messages.withColumn(column, F.when(F.expr(where), _nulled(F.col(column), messages, column, fields)).otherwise(F.col(column)))


def reset_pending(messages: DataFrame) -> DataFrame:
    """Pending transcriptions are open again."""
    return clear_fields(messages, fields=("transcription_status",), where="attachment.transcription_status = 'PENDING'")


def clear_classification(messages: DataFrame) -> DataFrame:
    return messages.withColumn("classification", F.lit(None).cast(CLASSIFICATION))
