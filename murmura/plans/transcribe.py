"""Speech transcription: a status machine over the attachment of a message.

open (null) -> PENDING -> SUCCESS or FAILURE. Media without sound succeed without a text; a failure is final; pending
ones are reset to open when nothing is being worked on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.refs import media_path
from murmura.functions.text import transcription_text
from murmura.models import _loaded
from murmura.operators.filters import unprocessed_audio
from murmura.operators.mutate import merge_fields
from murmura.settings import Settings
from murmura.sources import blobs

DEFAULT = Settings()
RESULT_FIELDS = ("transcription_status", "transcription", "transcription_language", "transcription_language_probability")


def usable(messages: DataFrame) -> DataFrame:
    """(id, path): the file of each message; messages without an id, refs or a file other than a thumbnail are left out."""
    return messages.where("id is not null").select("id", media_path(F.col("attachment.storage_refs")).alias("path")).where("path is not null").dropDuplicates(["id"])


def open_media(messages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return usable(messages.where(unprocessed_audio(settings.asr_attachment_types)))


def outcome(segments: Column, language: Column, probability: Column, no_audio: Column, failed: Column) -> list[Column]:
    """The fields of the attachment that a transcription sets: language and probability only beside a text."""
    text = transcription_text(segments)
    has_text = ~failed & ~no_audio & text.isNotNull()
    status = F.when(failed, "FAILURE").otherwise("SUCCESS")
    values = (status, F.when(has_text, text), F.when(has_text, language), F.when(has_text, probability))
    return [v.alias(n) for n, v in zip(RESULT_FIELDS, values, strict=True)]


def mark_pending(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """The table with the chosen messages' status set to PENDING."""
    return merge_fields(messages, chosen.select("id", F.lit("PENDING").alias("transcription_status")), "attachment", ("transcription_status",))


def _spoken(frames: Iterator[pd.DataFrame], model: str) -> Iterator[pd.DataFrame]:
    run = _loaded("speech", model, None, True)
    for frame in frames:
        rows = []
        for i, content in zip(frame["id"], frame["content"], strict=True):
            try:
                segments, language, probability = run([content])[0]
                rows.append((i, list(segments), language, float(probability), False, False))
            except IndexError:  # no sound in the file
                rows.append((i, [], None, None, True, False))
            except Exception:
                rows.append((i, [], None, None, False, True))
        yield pd.DataFrame(rows, columns=["id", "segments", "language", "probability", "no_audio", "failed"])


def transcribe(chosen: DataFrame, media: str | DataFrame, model: str = "standin") -> DataFrame:
    """(id, status, text, language, probability) of (id, path); a file that is missing or empty stays pending."""
    schema = "id string, segments array<string>, language string, probability double, no_audio boolean, failed boolean"
    spoken = blobs.with_content(chosen.select("id", "path"), media).where("content is not null").select("id", "content").mapInPandas(partial(_spoken, model=model), schema)
    return spoken.select("id", *outcome(F.col("segments"), F.col("language"), F.col("probability"), F.col("no_audio"), F.col("failed")))


def run(messages: DataFrame, media: str | DataFrame, settings: Settings = DEFAULT, model: str = "standin") -> DataFrame:
    """The table after one run: chosen messages pending, then those with a file done."""
    chosen = open_media(messages, settings)
    return merge_fields(mark_pending(messages, chosen), transcribe(chosen, media, model), "attachment", RESULT_FIELDS)
