"""Vector tables: partitioned by chat, created by the first write, appended without duplicates."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.operators.incremental import without_result
from murmura.operators.metrics import counted, counts
from murmura.sources import blobs


log = logging.getLogger(__name__)


def attempt(write: Callable[[], None], attempts: int = 3, wait_s: float = 1.0, fatal: tuple[type[Exception], ...] = (ValueError,)) -> None:
    """Run a write up to ``attempts`` times; errors in the data are raised at once, the last other error is raised too.

    Tasks are retried by Spark itself; this covers what fails as a whole, such as a store that is away for a moment.
    """
    for k in range(attempts):
        try:
            return write()
        except fatal:
            raise
        except Exception:
            if k == attempts - 1:
                raise
            log.warning("write failed, attempt %d of %d", k + 1, attempts, exc_info=True)
            time.sleep(wait_s * 2**k)


def create(spark: SparkSession, path: str, schema: str) -> bool:
    """Lay down an empty table where there is none; whether one was laid down. Two writers at once do no harm."""
    if blobs.exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("chat_id").parquet(path)
    return True


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one where it does not exist yet."""
    return spark.read.schema(schema).parquet(path) if blobs.exists(spark, path) else spark.createDataFrame([], schema)


#: Files that a chat's rows of one append are spread over at most; chats that an append names to the table at most.
FILES_PER_CHAT, CHATS_NAMED = 8, 10_000


def append(rows: DataFrame, path: str, key: str = "message_id") -> int:
    """Append, and return how many rows; a task that is repeated replaces what it wrote (the committer's rule), so rows come once.

    A chat's rows meet in a few tasks first, so that an append adds few files to a chat, and a chat of many rows still spreads.
    """
    counted_rows, seen = counted(rows)
    placed = counted_rows.repartition("chat_id", F.pmod(F.xxhash64(key), F.lit(FILES_PER_CHAT)))
    attempt(lambda: placed.write.mode("append").partitionBy("chat_id").parquet(path))
    return counts(seen)["total"]


def append_new(rows: DataFrame, path: str, schema: str, keys: Sequence[str] = ("message_id", "source_field")) -> int:
    """Append only rows whose key is not in the table: a batch that is delivered again adds nothing.

    Of the table only the partitions of the batch's chats are read, where these are few enough to be named.
    """
    known = read(rows.sparkSession, path, schema)
    named = [r[0] for r in rows.select("chat_id").distinct().limit(CHATS_NAMED + 1).collect()]
    if len(named) <= CHATS_NAMED:
        some = F.col("chat_id").isin([c for c in named if c is not None])
        known = known.where(some | F.col("chat_id").isNull() if None in named else some)
    return append(without_result(rows.dropDuplicates(list(keys)), known, keys), path)


def drop(spark: SparkSession, path: str) -> bool:
    return blobs.delete(spark, path)


def chats(rows: DataFrame) -> DataFrame:
    """The chats of a table: its partitions."""
    return rows.select("chat_id").distinct()
