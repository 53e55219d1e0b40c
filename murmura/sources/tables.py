"""Reading tables and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from murmura.sources import blobs


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    """The Parquet table ``name`` of a data directory; with a schema, an empty one where it does not exist yet."""
    path = f"{sf_dir}/{name}.parquet"
    if schema and not blobs.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the session names none (local tests)."""
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a shared folder")
        set_dir = tempfile.mkdtemp(prefix="murmura-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", set_dir) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(set_dir)
    return set_dir


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the files: lost executors then recompute nothing before them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from it: as ``cut_lineage``, but readers fetch only the columns they need.

    The table lasts as long as the folder's owner keeps it, for the result is read after this returns.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/murmura-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
