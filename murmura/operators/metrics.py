"""Counts that a job reports about itself while it runs, without a second pass."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(rows: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that holds ``total`` and a count for each condition once an action has run over them."""
    seen = Observation()
    counts = [F.count_if(c).alias(n) for n, c in conditions.items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("total"), *counts), seen


def counts(seen: Observation, *names: str) -> dict[str, int]:
    """What an observation holds after the action; zeros where the planner found that there are no rows and left the counting out."""
    try:
        return dict(seen.get)
    except Py4JJavaError:
        return dict.fromkeys(("total", *names), 0)


def timed(run: Callable[[], object]) -> tuple[object, float]:
    """A result and the seconds it took."""
    began = time.monotonic()
    return run(), time.monotonic() - began
