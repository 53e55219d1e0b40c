"""Times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_now() -> Column:
    """The time of the run in UTC, without a zone; one value for a whole query, whatever the session's zone."""
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())
