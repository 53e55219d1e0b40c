"""Text vectors: one row for each message and non-empty field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.times import utc_now
from murmura.models import encode_column
from murmura.operators.filters import to_embed
from murmura.settings import Settings

DEFAULT = Settings()


def explode_fields(messages: DataFrame, fields: Sequence[str] = DEFAULT.text_embedding_fields) -> DataFrame:
    """(message_id, chat_id, language, date, source_field, content): non-empty fields, dotted names reach into structs."""
    pairs = F.array(*[F.struct(F.lit(f).alias("source_field"), F.col(f).alias("content")) for f in fields])
    rows = messages.select(F.col("id").alias("message_id"), "chat_id", "language", "date", F.inline(pairs))
    return rows.where("content is not null and content <> ''")


def embed(messages: DataFrame, settings: Settings = DEFAULT, model: str = "standin", processed_at: Column | None = None) -> DataFrame:
    """Rows of the table of text vectors; a message that comes twice has its vectors once."""
    at = utc_now() if processed_at is None else processed_at
    parts = explode_fields(messages.where(to_embed(settings.text_embedding_fields)), settings.text_embedding_fields).dropDuplicates(["message_id", "source_field"])
    vector = encode_column(F.col("content"), model, batch=settings.text_model_batch)
    return parts.select("message_id", "chat_id", "language", "date", at.alias("processed_at"), "source_field", vector.alias("vector"))
