"""Classification: pending messages, cleaned and gated by length, get a positive-class score or an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.text import alnum_length, clean, first_filled, length_error
from murmura.functions.times import utc_now
from murmura.models import classify_column, positive_score
from murmura.operators.filters import unclassified
from murmura.operators.mutate import set_struct
from murmura.settings import Settings

DEFAULT = Settings()


def preprocess(rows: DataFrame, minimum: int = DEFAULT.classification_min_length, text: str = "text") -> DataFrame:
    """The rows with the text cleaned, its length in letters and numerals, and the error of one that is too short."""
    cleaned = rows.withColumn(text, clean(F.col(text))).withColumn("text_length", alnum_length(F.col(text)))
    return cleaned.withColumn("error", length_error(F.col("text_length"), minimum))


def pending(messages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(id, text): the first filled field of every pending message; those with none are left out."""
    fields = settings.classification_fields
    rows = messages.where(unclassified(fields, settings.classification_languages))
    return rows.select("id", first_filled(*[F.col(f) for f in fields]).alias("text")).where("text is not null")


def classify(documents: DataFrame, settings: Settings = DEFAULT, model: str = "standin", processed_at: Column | None = None) -> DataFrame:
    """(id, classification) of (id, text). One pass: texts with an error are null to the model, which leaves nulls out."""
    at = utc_now() if processed_at is None else processed_at
    ready = preprocess(documents, settings.classification_min_length)
    asked = F.when(F.col("error").isNull(), F.col("text"))
    scored = ready.select("id", "error", classify_column(asked, model, batch=settings.classification_batch).alias("r"))
    passed = F.col("error").isNull()
    score = F.when(passed, positive_score(F.col("r.label"), F.col("r.score")))
    return scored.select("id", F.struct(passed.alias("classified"), score.alias("score_pos"), F.col("error"), at.alias("processed_at")).alias("classification"))


def run(messages: DataFrame, settings: Settings = DEFAULT, model: str = "standin", processed_at: Column | None = None) -> DataFrame:
    """The table of messages with the classifications of pending ones filled in."""
    results = classify(pending(messages, settings).dropDuplicates(["id"]), settings, model, processed_at)
    return set_struct(messages, results, "classification")
