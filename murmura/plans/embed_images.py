"""Image vectors: one row for each message with a photo, from the file and its caption together."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.media import image_header
from murmura.functions.refs import attachment_type, photo_object
from murmura.functions.times import utc_now
from murmura.models import _loaded
from murmura.operators.filters import images
from murmura.settings import Settings
from murmura.sources import blobs

DEFAULT = Settings()


def pending(messages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(message_id, chat_id, date, attachment_type, path, caption): the photo of each message; those without one are left out."""
    rows = messages.where(images(settings.image_attachment_types))
    photo = photo_object(F.col("attachment.storage_refs"))
    return (
        rows.select(F.col("id").alias("message_id"), "chat_id", "date", attachment_type(F.col("attachment")).alias("attachment_type"), F.concat(F.lit("photos/"), photo).alias("path"), F.coalesce("caption", F.lit("")).alias("caption"))
        .where("path is not null")
        .dropDuplicates(["message_id"])
    )


def _encoded(frames: Iterator[pd.DataFrame], model: str, batch: int) -> Iterator[pd.DataFrame]:
    run = _loaded("image", model, None, True)
    for frame in frames:
        vectors: list = [None] * len(frame)
        errors: list = [None] * len(frame)
        good = []
        for i, (path, content) in enumerate(zip(frame["path"], frame["content"], strict=True)):
            if content is None:
                errors[i] = f"no file: {path}"
                continue
            try:
                image_header(content)
                good.append(i)
            except ValueError as e:
                errors[i] = str(e)
        pairs = list(zip(frame["content"], frame["caption"], strict=True))
        for a in range(0, len(good), batch):
            part = good[a : a + batch]
            try:
                found = run([pairs[i] for i in part])
                if len(found) != len(part):
                    raise ValueError("the encoder's vectors do not match the images")
                for i, v in zip(part, found, strict=True):
                    vectors[i] = np.asarray(v, dtype=np.float32)
            except Exception:  # an image that the model fails on costs its own row, not its batch
                for i in part:
                    try:
                        vectors[i] = np.asarray(run([pairs[i]])[0], dtype=np.float32)
                    except Exception as e:
                        errors[i] = str(e)[:200]
        yield frame.drop(columns=["content", "caption", "path"]).assign(vector=vectors, error=errors)


def embed(messages: DataFrame, media: str | DataFrame, settings: Settings = DEFAULT, model: str = "standin", processed_at: Column | None = None) -> DataFrame:
    """Rows of the table of image vectors and an error column: a file that is missing or no image has an error and no vector.

    ``media`` is the folder of the files (see ``blobs.with_content``); each file is read once, by the task that encodes it.
    """
    at = utc_now() if processed_at is None else processed_at
    rows = blobs.with_content(pending(messages, settings), media).select("message_id", "chat_id", "date", "attachment_type", "path", "caption", "content")
    schema = "message_id string, chat_id string, date timestamp_ntz, attachment_type string, vector array<float>, error string"
    return rows.mapInPandas(partial(_encoded, model=model, batch=settings.image_model_batch), schema).withColumn("processed_at", at)
