"""Media files: reading them as a table, and the few file operations around it."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions.refs import BUCKETS, bucket_name
from murmura.settings import Settings


#: Files that a task holds at once.
FILES_AT_ONCE = 32


def media(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files under ``root``, where path is bucket/object; the content is read only where it is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").rsplit("/", 1)[-1]
    return files.select(F.regexp_extract("path", rf".*?/{base}/(.*)$", 1).alias("path"), "content")


def _read(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    store, base = pafs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))
    for batch in batches:
        for k in range(0, batch.num_rows, FILES_AT_ONCE):
            part = batch.slice(k, FILES_AT_ONCE)
            contents = []
            for path in part.column("path").to_pylist():
                try:
                    with store.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                        contents.append(f.readall())
                except (FileNotFoundError, IsADirectoryError):
                    contents.append(None)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*part.schema.names, "content"])


def with_content(rows: DataFrame, media: str | DataFrame) -> DataFrame:
    """The rows with the content of the file that ``path`` names; null where there is none.

    ``media`` is the folder or store of the files: each is read where its row is, nothing but paths travels. A table
    (path, content), for contents that are no files, is joined instead.
    """
    if isinstance(media, DataFrame):
        return rows.join(media.select("path", "content"), "path", "left").select(*rows.columns, "content")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", content binary"
    return rows.mapInArrow(partial(_read, root=media), schema)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put(spark: SparkSession, path: str, content: bytes) -> None:
    fs, where = _fs(spark, path)
    with_stream = fs.create(where, True)
    with_stream.write(bytearray(content))
    with_stream.close()


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file; whether it was not there before."""
    fs, where = _fs(spark, path)
    if fs.exists(where):
        return False
    return bool(fs.createNewFile(where))


def delete(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def ensure_buckets(spark: SparkSession, root: str, settings: Settings) -> list[str]:
    """Create the folders of all buckets that are not there; their names."""
    names = [bucket_name(b, settings) for b in BUCKETS]
    for n in names:
        fs, where = _fs(spark, f"{root.rstrip('/')}/{n}")
        if not fs.exists(where):
            fs.mkdirs(where)
    return names
