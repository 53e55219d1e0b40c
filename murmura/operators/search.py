"""Filtered similarity search over stored vectors, exact."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.operators.filters import checked_search, conjunction, date_range, in_chats
from murmura.operators.metrics import timed

#: Neighbours that one search considers.
K_MAX = 1000


def _heads(batches: Iterator[pa.RecordBatch], query: np.ndarray, k: int, keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The ``k`` best rows of a partition, scored a batch at a time by one matrix product in double."""
    dim, best = len(query), None
    order = [("score", "descending"), *((c, "ascending") for c in keys)]
    for batch in batches:
        vectors = batch.column("vector")
        full = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(vectors), -1)) == dim)
        if not len(full):
            continue
        x = vectors.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        good = np.flatnonzero(np.isfinite(size) & (size > 0))
        rows = pa.array(full[good])
        found = pa.table({**{c: batch.column(c).take(rows) for c in keys}, "score": (1 + (x[good] @ query) / size[good]) / 2})
        best = found if best is None else pa.concat_tables([best, found])
        if best.num_rows > k:
            best = best.take(pc.sort_indices(best, order)[:k])
    if best is not None:
        yield from best.combine_chunks().to_batches()


def knn(vectors: DataFrame, query: Sequence[float], size: int, condition: Column | None = None, k_max: int = K_MAX, key: str = "message_id", tie: Sequence[str] = ()) -> DataFrame:
    """(id, score) of the best ``min(size, k_max)`` vectors among those that meet the condition; ties by id, then ``tie``.

    The filter is at the scan, so the best of the filtered rows are found. Vectors that are null, of another length,
    all zero or not finite have no score. Each partition is reduced to its head, and only heads meet (TakeOrderedAndProject).
    """
    k, ask = min(size, k_max), np.asarray(query, dtype=np.float64)
    length = float(np.sqrt(ask @ ask))
    if not length:
        raise ValueError("the query vector is zero")
    rows = vectors.where(condition) if condition is not None else vectors
    picked = rows.select(F.col(key).alias("id"), *tie, "vector").where(F.size("vector") == len(ask))
    kinds = dict(picked.dtypes)
    keys = ["id", *tie]
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", score double"
    scored = picked.mapInArrow(partial(_heads, query=ask / length, k=k, keys=keys), schema)
    return scored.orderBy(F.desc("score"), *keys).limit(k).select("id", "score")


def collapse(hits: DataFrame) -> DataFrame:
    """The best score of each id, best first. It follows the top-k: hits that fall together are not filled up."""
    return hits.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id")


def search(vectors: DataFrame, query: Sequence[float], top_k: int = 500, date_from: datetime | None = None, date_to: datetime | None = None, chat_ids: Sequence[object] | None = None, k_max: int = K_MAX, tie: Sequence[str] = ()) -> DataFrame:
    """(id, score): hits of a query vector, filtered by date and chat, one row for each message."""
    condition = conjunction(date_range(date_from, date_to), in_chats(chat_ids))
    return collapse(knn(vectors, query, top_k, condition, k_max, tie=tie))


def search_images(vectors: DataFrame, query: str, encode, top_k: int = 500, **filters) -> DataFrame:
    """The same over vectors of images, by a text encoder of the joint model whose vectors are brought to length one."""

    def normalized(text: str) -> list[float]:
        v = [float(x) for x in encode(text)]
        size = sum(x * x for x in v) ** 0.5
        return [x / size for x in v] if size else []

    return search_text(vectors, query, normalized, top_k, **filters)


def search_text(vectors: DataFrame, query: str, encode, top_k: int = 500, **filters) -> DataFrame:
    """The search request: validates, encodes the query text and searches; a query without an encoding has an error."""
    checked_search(query, top_k)
    vector = encode(query)
    if not len(vector):
        raise ValueError("the query could not be encoded")
    return search(vectors, vector, top_k, **filters)


def timed_search(vectors: DataFrame, query: str, encode, top_k: int = 500, **filters) -> dict:
    """The answer to a search request: its hits, their number, and the seconds that encoding and searching took."""
    vector, encoding = timed(lambda: encode(query))
    hits, searching = timed(lambda: [(r["id"], r["score"]) for r in search_text(vectors, query, lambda _: vector, top_k, **filters).collect()])
    return {"hits": hits, "total": len(hits), "encoding_s": encoding, "searching_s": searching}
