"""Attachments, storage references and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmura.settings import Settings

#: The buckets of the object store.
BUCKETS = ("thumbnails", "photos", "audios", "documents", "videos", "voices", "video-notes")


def exists_any(refs: Column) -> Column:
    """Whether a list of refs holds any value: null, empty and all-null lists hold none."""
    return F.coalesce(F.exists(refs, lambda r: r["bucket"].isNotNull() | r["object"].isNotNull()), F.lit(False))


def photo_object(refs: Column) -> Column:
    """Object of the first ref in the bucket of photos."""
    return F.get(F.filter(refs, lambda r: r["bucket"] == "photos"), F.lit(0))["object"]


def media_path(refs: Column) -> Column:
    """bucket/object of the first ref whose bucket is none of thumbnails, in any case of letters; null where a part is."""
    first = F.get(F.filter(refs, lambda r: ~F.contains(F.lower(r["bucket"]), F.lit("thumbnail"))), F.lit(0))
    return F.concat(first["bucket"], F.lit("/"), first["object"])


def bucket_of(path: Column) -> Column:
    return F.split(path, "/", 2)[0]


def object_of(path: Column) -> Column:
    return F.get(F.split(path, "/", 2), F.lit(1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def attachment_type(attachment: Column) -> Column:
    """The type; photo where it is missing or empty."""
    kind = attachment["type"]
    return F.when(kind != "", kind).otherwise(F.lit("photo"))


def chat_of_table(name: Column) -> Column:
    """The chat a table is of: what follows the last underscore."""
    return F.substring_index(name, "_", -1)


def table_of_chat(prefix: str, chat_id: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), chat_id)


def bucket_name(bucket: str, settings: Settings) -> str:
    return f"{settings.storage_bucket_prefix}{bucket}"


def endpoint(settings: Settings) -> str | None:
    """Address of the object store; none for the provider's own."""
    if settings.storage_provider == "aws":
        return None
    if settings.storage_endpoint.startswith(("http://", "https://")):
        return settings.storage_endpoint
    return f"{'https' if settings.storage_use_ssl else 'http'}://{settings.storage_endpoint}"
