"""Filling containers of one capacity with items of varying length.

Only the histogram of lengths (at most ``capacity`` rows, whatever the corpus) reaches the driver. There the
configuration linear program - as few containers as possible, each filled by a multiset of lengths, every item covered -
is solved by multiplicative weights: a weight for each length prices a configuration by knapsack dynamic programming
(no more items of a length than there are), the weights of what it covers shrink, and so on. The solution is rounded by
diving: under the program's weights, which go on learning, the best configuration of the items left is priced and used
a whole number of times - a share of what is left of its scarcest length, once at least - until ``DIVES`` are made. What then
remains, if anything, is packed by descending length. Items find their container by their number among those of their length.

Results: one row for each piece of each text. A text over the capacity is cut into full pieces and a rest; no other is
cut. Texts without tokens take no room: one row with size 0 in container 0. ``container_id`` counts from 0 without gaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPACITY = 2048
#: Items of a length that one task numbers; more are numbered in parts.
ROWS = 1_000_000
ROUNDS, DIVES = 120, 12_000
#: Lengths that one dive prices: those of which most is left, and the longest.
FREQUENT, LONGEST = 96, 24


def price(sizes: np.ndarray, worth: np.ndarray, capacity: int, most: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """The most worth that one container can hold, and how many items of each size (up to ``most``) it then holds."""
    most = capacity // sizes if most is None else np.minimum(most, capacity // sizes)
    # A bounded number of items is a choice among 1, 2, 4, ... of them.
    items: list[tuple[int, int]] = []
    for j, n in enumerate(most.tolist()):
        k = 1
        while n > 0:
            items.append((j, min(k, n)))
            n -= k
            k *= 2
    best = np.zeros(capacity + 1)
    took = np.zeros((len(items), capacity + 1), dtype=bool)
    size, value = sizes.tolist(), worth.tolist()
    for i, (j, k) in enumerate(items):
        s = size[j] * k
        offer = best[:-s] + value[j] * k
        np.greater(offer, best[s:] + 1e-12, out=took[i, s:])
        np.maximum(best[s:], offer, out=best[s:])
    counts = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    for i in range(len(items) - 1, -1, -1):
        if took[i, c]:
            j, k = items[i]
            counts[j] += k
            c -= size[j] * k
    return float(best[capacity]), counts


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = 0.5) -> tuple[np.ndarray, float]:
    """The program's weights (the worth of an item of each size) and a lower bound of its value."""
    weight = sizes / capacity
    bound = float(demand @ sizes) / capacity
    for _ in range(rounds):
        worth, counts = price(sizes, weight, capacity)
        # Weights over the best configuration's worth satisfy the dual program.
        bound = max(bound, float(demand @ weight) / worth)
        share = float((demand[counts > 0] / counts[counts > 0]).min())
        weight = weight * np.exp(-step * counts * share / demand)
        weight /= (weight * demand).sum() / (sizes * demand).sum() * capacity
    return weight, bound


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, dives: int = DIVES) -> tuple[list[tuple[int, dict[int, int]]], float, int]:
    """((number of containers, {size: items in each}), ...) that hold ``demand`` exactly, a lower bound of the number of
    containers, and how many of them the program gave."""
    sizes, demand = np.asarray(sizes, dtype=np.int64), np.asarray(demand, dtype=np.int64)
    if not len(sizes):
        return [], 0.0, 0
    weight, bound = relaxed(sizes, demand.astype(float), capacity, rounds)
    left = demand.copy()
    out: list[tuple[int, dict[int, int]]] = []

    def use(counts: np.ndarray, times: int) -> None:
        nonlocal left
        left = left - counts * times
        out.append((times, {int(s): int(c) for s, c in zip(sizes[counts > 0], counts[counts > 0], strict=True)}))

    # Full containers are worth much the same; of them, those of long items come first: short ones fill what they leave.
    tilt = 1 + 0.3 * (sizes / capacity) ** 2
    for _ in range(dives):
        at = np.flatnonzero(left)
        if not len(at):
            break
        if len(at) > FREQUENT + LONGEST:
            most = at[np.argpartition(-left[at] * sizes[at], FREQUENT)[:FREQUENT]]
            at = np.union1d(most, at[-LONGEST:])
        _, held = price(sizes[at], (weight * tilt)[at], capacity, left[at])
        counts = np.zeros(len(sizes), dtype=np.int64)
        counts[at] = held
        some = counts > 0
        share = int((left[some] // counts[some]).min())
        use(counts, max(1, share - share // 4))
        weight[some] *= np.exp(-0.02 * counts[some] / np.maximum(1, demand[some]))
    planned = sum(times for times, _ in out)
    # What is left: the longest item first, then the longest that still fits, in bulk.
    order = np.argsort(-sizes, kind="stable")
    while left.any():
        counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for j in order.tolist():
            if left[j] and sizes[j] <= room:
                counts[j] = min(left[j], room // sizes[j])
                room -= int(counts[j] * sizes[j])
                if not room:
                    break
        held = counts > 0
        use(counts, int((left[held] // counts[held]).min()))
    return out, bound, planned


def _assign(batches: Iterator[pa.RecordBatch], slots: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, number = batch.column("size").to_numpy(), batch.column("number").to_numpy()
        container = np.zeros(len(size), dtype=np.int64)
        for s in np.unique(size):
            if s == 0:
                continue
            upto, first, per = slots[int(s)]
            at = np.flatnonzero(size == s)
            p = np.searchsorted(upto, number[at], side="right")
            begun = np.concatenate([[0], upto])[p]
            container[at] = first[p] + (number[at] - begun) // per[p]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece_no", "size")), pa.array(container)], names=["doc_id", "piece_no", "size", "container_id"])


def slots(planned: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size and configuration holding it: items up to it, its first container, items in each container."""
    first, lists = 0, {}
    for times, counts in planned:
        for s, c in counts.items():
            upto, firsts, per = lists.setdefault(s, ([], [], []))
            upto.append((upto[-1] if upto else 0) + times * c)
            firsts.append(first)
            per.append(c)
        first += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in v) for s, v in lists.items()}


def fill(sizes: DataFrame, capacity: int = CAPACITY, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece_no, size, container_id) of (doc_id, n_tokens)."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = sizes.sparkSession
    pieces = F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int"), F.lit(1))
    items = (
        sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
        .select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
        .select("doc_id", "piece_no", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).cast("int").alias("size"))
    )
    # At most capacity + 1 rows, whatever the corpus; of a frequent length one more for each ``rows`` items.
    counted = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}
    parts = spark.createDataFrame([(s, -(-n // rows)) for s, n in counted.items()], "size int, parts int")
    salted = items.join(F.broadcast(parts), "size").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("parts")).cast("int")).drop("parts")
    before: dict[int, int] = {}
    offsets = []
    for s, salt, n in sorted(tuple(r) for r in salted.groupBy("size", "salt").count().collect()) if max(counted.values(), default=0) > rows else [(s, 0, n) for s, n in counted.items()]:
        offsets.append((s, salt, before.get(s, 0)))
        before[s] = before.get(s, 0) + n
    held = sorted(s for s in before if s > 0)
    planned, _, _ = plan(np.array(held), np.array([before[s] for s in held]), capacity, rounds)
    offset = spark.createDataFrame(offsets, "size int, salt int, offset bigint")
    numbered = (
        salted.join(F.broadcast(offset), ["size", "salt"])
        .withColumn("number", F.row_number().over(W.partitionBy("size", "salt").orderBy("doc_id", "piece_no")) - 1 + F.col("offset"))
        .select("doc_id", "piece_no", "size", "number")
    )
    return numbered.mapInArrow(partial(_assign, slots=slots(planned)), "doc_id bigint, piece_no int, size int, container_id bigint")
