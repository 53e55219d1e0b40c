"""Predicates as column expressions; all push down to the scan as far as the format can."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.refs import exists_any


def after(cursor: datetime | None, date: str = "date") -> Column:
    """Strictly later than a cursor; no cursor, no filter."""
    return F.lit(True) if cursor is None else F.col(date) > F.lit(naive(cursor))


def naive(at: datetime) -> datetime:
    """UTC without zone."""
    return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at


def unclassified(fields: Sequence[str] = ("text", "caption"), languages: Sequence[str] = ("de",), allow_multi: bool = False) -> Column:
    """No classification, a supported language, and exactly one of the fields (at least one with ``allow_multi``)."""
    count = reduce(Column.__add__, [F.col(f).isNotNull().cast("int") for f in fields])
    filled = count >= 1 if allow_multi else count == 1
    return F.col("classification").isNull() & filled & F.col("language").isin(*languages)


def unprocessed_audio(types: Sequence[str] = ("audio", "voice")) -> Column:
    return F.col("attachment.transcription_status").isNull() & F.col("attachment.type").isin(*types)


def to_embed(fields: Sequence[str] = ("text", "caption")) -> Column:
    return reduce(Column.__or__, [F.col(f).isNotNull() for f in fields])


def images(types: Sequence[str] = ("photo",)) -> Column:
    return exists_any(F.col("attachment.storage_refs")) & F.col("attachment.type").isin(*types)


def date_range(start: datetime | None = None, end: datetime | None = None, date: str = "date") -> Column:
    """start <= date < end, each bound optional."""
    bounds = [F.col(date) >= F.lit(naive(start))] if start else []
    bounds += [F.col(date) < F.lit(naive(end))] if end else []
    return conjunction(*bounds)


def in_chats(chat_ids: Sequence[object] | None, chat: str = "chat_id") -> Column:
    """One of the chats, which may be given as numbers; none given, no filter."""
    return F.col(chat).isin(*[str(c) for c in chat_ids]) if chat_ids else F.lit(True)


def conjunction(*conditions: Column) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def has_attachment_type(messages: DataFrame, kind: str) -> bool:
    """Whether any attachment is of a type: stops at the first."""
    return not messages.where(F.col("attachment.type") == kind).select(F.lit(1)).limit(1).isEmpty()


def attachment_type_by_chat(messages: DataFrame, kind: str, chat: str = "chat_id") -> DataFrame:
    """(chat_id, found): the same for every chat at once."""
    return messages.groupBy(chat).agg(F.coalesce(F.bool_or(F.col("attachment.type") == kind), F.lit(False)).alias("found"))


def has_field(table: DataFrame, name: str) -> bool:
    """Whether a table has a column, dotted for nested ones."""
    kind = table.schema
    for part in name.split("."):
        kind = getattr(kind, "elementType", kind)
        if part not in getattr(kind, "names", ()):
            return False
        kind = kind[part].dataType
    return True


def checked_search(query: str, top_k: int) -> None:
    """Parameters of a search request."""
    if not 1 <= top_k <= 10_000:
        raise ValueError("top_k must be from 1 to 10000")
    if not query or not query.strip():
        raise ValueError("the query must not be blank")
