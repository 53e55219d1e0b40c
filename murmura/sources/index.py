"""A stored index for similarity search: vectors laid out by lists, so that a search reads few of them.

Centroids come from k-means over a bounded sample; every usable vector is stored in the folder of its nearest centroid's
list, and each list knows the least cosine between a member and its centroid. A search reads the nearest ``probes`` lists first. An exact
one then reads the lists that may still hold something better: those whose centroid is so near that, with the list's
greatest angle, a member could beat the last hit (triangle inequality on angles).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions.vectors import usable
from murmura.operators.search import K_MAX, knn
from murmura.schemas import SEARCH_HITS

#: Rows that centroids are learned from, rows of the sample for each list, rounds of k-means.
SAMPLE, PER_LIST, ROUNDS = 50_000, 40, 8
PROBES = 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learned(sample: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """Unit centroids of spherical k-means over unit rows."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(ROUNDS):
        near = (sample @ c.T).argmax(1)
        for j in range(n):
            mean = sample[near == j].sum(0)
            if np.linalg.norm(mean) > 0:
                c[j] = mean / np.linalg.norm(mean)
    return c


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _unit(batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)) if batch.num_rows else np.empty((0, centroids.shape[1]))
        s = x @ centroids.T
        near = s.argmax(1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(s[np.arange(len(near)), near])], names=[*batch.schema.names, "list", "to_centroid"])


def build(vectors: DataFrame, path: str, dim: int, lists: int | None = None, sample: int = SAMPLE) -> int:
    """Store the usable vectors under ``path`` by lists; the number of lists. Of none the index is empty, and searches find nothing."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col("vector"), dim))
    n = rows.count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 30))
    drawn = [r[0] for r in rows.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < share).select("vector").collect()]
    x = _unit(np.array(drawn, dtype=np.float64)) if drawn else np.ones((1, dim)) / np.sqrt(dim)
    centroids = learned(x, max(1, min(lists or len(x) // PER_LIST, len(x))))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", list int, to_centroid double"
    rows.mapInArrow(partial(_assigned, centroids=centroids), schema).repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    held = {r["list"]: r["least"] for r in _stored(spark, path, schema).groupBy("list").agg(F.min("to_centroid").alias("least")).collect()}
    table = [(j, [float(v) for v in c], held[j]) for j, c in enumerate(centroids) if j in held]
    spark.createDataFrame(table, "list int, centroid array<double>, least double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return len(table)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/vectors")


def search(spark: SparkSession, path: str, query: Sequence[float], size: int, probes: int = PROBES, exact: bool = True, condition: Column | None = None, k_max: int = K_MAX, tie: Sequence[str] = ()) -> DataFrame:
    """(id, score) of the best vectors as ``operators.search.knn`` gives them; without ``exact`` only those of the nearest lists."""
    lists = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    q = np.asarray(query, dtype=np.float64)
    k = min(size, k_max)
    if not lists:
        return spark.createDataFrame([], SEARCH_HITS)
    stored = spark.read.parquet(f"{path}/vectors")
    similar = np.array([r["centroid"] for r in lists]) @ (q / np.linalg.norm(q))
    order = np.argsort(-similar, kind="stable")
    chosen = order[:probes]

    def among(picked: np.ndarray) -> DataFrame:
        rows = stored.where(F.col("list").isin([lists[i]["list"] for i in picked.tolist()]))
        return knn(rows, query, size, condition, k_max, tie=tie)

    if not exact or len(chosen) == len(lists):
        return among(chosen)
    hits = among(chosen).collect()
    if len(hits) < k:
        return among(order)
    # The best cosine that a member of a list can have: its centroid's angle less the list's greatest.
    angle = np.arccos(np.clip(similar, -1, 1)) - np.arccos(np.clip([r["least"] for r in lists], -1, 1))
    bound = (1 + np.cos(np.maximum(angle, 0))) / 2
    return among(np.union1d(chosen, np.flatnonzero(bound >= hits[-1]["score"] - 1e-9)))


def recall(spark: SparkSession, path: str, queries: Sequence[Sequence[float]], size: int, probes: int = PROBES) -> float:
    """The share of the exact hits that a search of ``probes`` lists finds."""
    found = total = 0
    for q in queries:
        want = {tuple(r) for r in search(spark, path, q, size, probes).collect()}
        found += len(want & {tuple(r) for r in search(spark, path, q, size, probes, exact=False).collect()})
        total += len(want)
    return found / total if total else 1.0
