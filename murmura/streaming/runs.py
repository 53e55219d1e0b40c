"""Periodic runs as file streams: each run takes what has arrived since the last and ends (available now).

The checkpoint of a stream is its state: removing it starts anew. A batch may be delivered again after a failure, so
sinks write a batch under its own number or append only keys that are new.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.operators.metrics import counted, counts, timed
from murmura.plans import classify, embed_images, embed_text
from murmura.schemas import IMAGE_VECTORS, MESSAGES, TEXT_VECTORS
from murmura.settings import Settings
from murmura.sources import blobs, vectors


def arrivals(spark: SparkSession, path: str, schema: str = MESSAGES, files_at_once: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive under ``path``; ``files_at_once`` keeps a run from taking too many."""
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], dict], checkpoint: str) -> dict:
    """Work off what is there; the sums of what ``each`` counts, the number of batches and the seconds taken."""
    total: dict = {"batches": 0}

    def batch(rows: DataFrame, number: int) -> None:
        for name, n in (each(rows, number) or {}).items():
            total[name] = total.get(name, 0) + n
        total["batches"] += 1

    def work() -> None:
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    _, seconds = timed(work)
    return total | {"seconds": seconds}


def alone(spark: SparkSession, checkpoint: str, work: Callable[[], dict]) -> dict | None:
    """Run ``work`` unless another run over the same state is at it (then None): the lock is a file that only one can create."""
    lock = f"{checkpoint.rstrip('/')}.lock"
    if not blobs.create_new(spark, lock):
        return None
    try:
        return work()
    finally:
        blobs.delete(spark, lock)


def every(minutes: float, work: Callable[[], object], times: int | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
    """Call ``work`` at a fixed interval (``Settings`` holds one for each kind of run); a call that takes longer delays the next."""
    k = 0
    while times is None or k < times:
        _, took = timed(work)
        k += 1
        if times is None or k < times:
            sleep(max(0.0, minutes * 60 - took))


def classify_arrivals(spark: SparkSession, source: str, out: str, checkpoint: str, settings: Settings | None = None, model: str = "standin", schema: str = MESSAGES) -> dict:
    """Classify arriving messages; results of a batch are written under its number, so a repeated batch replaces itself."""
    chosen = settings or Settings()

    def each(batch: DataFrame, number: int) -> dict:
        results = classify.classify(classify.pending(batch, chosen).dropDuplicates(["id"]), chosen, model)
        rows, seen = counted(results, failed=F.col("classification.error").isNotNull())
        vectors.attempt(lambda: rows.write.mode("overwrite").parquet(f"{out}/batch={number}"))
        return counts(seen, "failed")

    return run_available(arrivals(spark, source, schema), each, checkpoint)


def embed_arrivals(spark: SparkSession, source: str, out: str, checkpoint: str, settings: Settings | None = None, model: str = "standin", schema: str = MESSAGES) -> dict:
    """Embed arriving messages, late ones too; a key that is there is not written again."""
    chosen = settings or Settings()

    def each(batch: DataFrame, number: int) -> dict:
        return {"total": vectors.append_new(embed_text.embed(batch, chosen, model), out, TEXT_VECTORS)}

    return run_available(arrivals(spark, source, schema), each, checkpoint)


def vectorize_arrivals(spark: SparkSession, source: str, media: str | DataFrame, out: str, checkpoint: str, settings: Settings | None = None, model: str = "standin", schema: str = MESSAGES) -> dict:
    """Vectors of the photos of arriving messages; images without a vector are left for a later run."""
    chosen = settings or Settings()

    def each(batch: DataFrame, number: int) -> dict:
        rows = embed_images.embed(batch, media, chosen, model).where("vector is not null").drop("error")
        return {"total": vectors.append_new(rows, out, IMAGE_VECTORS, ("message_id",))}

    return run_available(arrivals(spark, source, schema), each, checkpoint)


def start_anew(spark: SparkSession, checkpoint: str) -> bool:
    """Forget what a stream has done."""
    return blobs.delete(spark, checkpoint)
