"""The k most similar vectors of every vector, by adaptive scans of inverted lists.

Vectors are put into lists by their most similar centroid; the centroids come from k-means over a bounded sample
(rows picked by a hash of the key; every row is put into a list and asked for), in two levels where there are many. The number of
lists grows with the rows, from ``MANY`` lists on with their square root, so that the work is about n ** 1.5.

Which further lists a vector probes is set by measurement: about ``ASKED`` vectors are compared with all rows, and the
narrowest rule (a share of, or a distance from, the similarity to the nearest centroid) under which ``TARGET`` of their true neighbours lie in
probed lists is taken; there is no cap on the lists probed. If that rule would probe more than ``EXACT_SHARE`` of the
lists - no list can help with vectors that are spread evenly - all pairs are compared, in tiles: the exact mode, which ``exact`` also asks for.

Within a list, vectors are rotated by a fixed random
rotation and compared in blocks of columns: the distance over the first d columns, times D/d, estimates the whole
distance, and a candidate is abandoned as soon as the hypothesis that it is within the k-th best distance found so far
is rejected (at ``EPSILON`` / sqrt(d) relative error). What survives all blocks has its cosine computed in double.

Vectors travel as half-precision numbers scaled by a power of two: two bytes a dimension, once for their own list and
once for each further list probed; similarities are cosines of these (off by some 1e-5). Lists over ``BLOCK`` rows are tiled into blocks of candidates and of queries, so a
list that holds a third of all vectors is still spread over the cluster.

Of vectors that are equal (every stored number, up to a power of two) only the k + 1 rows of least key take part in the search: they are
the best neighbours of all others of their kind, so a vector that a third of all rows share costs no more than its k + 1.

Results: usable are vectors of full length without null or NaN or infinite entries and not all zero; others neither ask nor answer.
Every usable row counts, equal vectors too. Rows of (key, neighbour, similarity): at most k for each key, ties by the smaller neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows a list has on average up to MANY lists; from there on the number of lists grows with the square root of the rows.
LIST, MANY = 256, 4096
#: Rows of the sample that lists are learned from: so many for each list, and bounds of the whole.
PER_LIST, LEAST_SAMPLE, SAMPLE = 16, 20_000, 400_000
#: More lists are learned in two levels.
FLAT = 2048
#: Vectors whose true neighbours are sought among all rows to set the probes, and the share of those that must be in probed lists.
ASKED, TARGET, EXACT_SHARE = 400, 0.999, 0.35
BLOCK = 20_000
EPSILON, COLUMNS = 2.1, (64, 192)


def number_of_lists(n: int, per_list: int = LIST) -> int:
    return max(1, min(n // per_list, max(MANY, int(MANY * (n / (MANY * per_list)) ** 0.5))))


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers of the usable vectors, their values in double)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    full = np.flatnonzero(lengths == dim)
    if not len(full):
        return full, np.empty((0, dim))
    flat = column.take(pa.array(full)).flatten()
    v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
    good = np.isfinite(v).all(1) & (v != 0).any(1)
    return full[good], v[good]


def packed(v: np.ndarray) -> np.ndarray:
    """Half-precision rows, scaled by a power of two so that the largest entry is in [0.5, 1)."""
    _, e = np.frexp(np.abs(v).max(1))
    return np.ldexp(v, -e[:, None]).astype(np.float16)


def unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def centroids(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of spherical k-means; of many, those of coarse clusters first and then of each cluster's own rows."""
    n = min(n, len(sample))
    if n > FLAT:
        coarse = centroids(sample, int(n**0.5), rounds, seed)
        near = np.concatenate([(sample[a : a + 4096] @ coarse.T).argmax(1) for a in range(0, len(sample), 4096)])
        parts = [np.flatnonzero(near == k) for k in range(len(coarse))]
        return np.concatenate([centroids(sample[p], max(1, round(n * len(p) / len(sample))), rounds, seed) for p in parts if len(p)])
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(sample), 4096)])
        order = np.argsort(near, kind="stable")
        first = np.searchsorted(near[order], np.arange(n))
        sums = np.add.reduceat(sample[order], np.minimum(first, len(sample) - 1), axis=0)
        norm = np.linalg.norm(sums, axis=1)
        some = (np.bincount(near, minlength=n) > 0) & (norm > 0)
        c[some] = sums[some] / norm[some, None]
    return c


def probes(x: np.ndarray, c: np.ndarray, rule: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every list that a row probes by ``rule`` (share of, distance from the greatest similarity); a row's own list is its first."""
    s = x @ c.T
    own = s.argmax(1)
    top = s[np.arange(len(x)), own]
    near = s >= _least(top, rule)[:, None]
    near[np.arange(len(x)), own] = False
    rows, lists = np.nonzero(near)
    rows, lists = np.concatenate([np.arange(len(x)), rows]), np.concatenate([own, lists])
    order = np.argsort(rows, kind="stable")
    return rows[order], lists[order]


def _least(top: np.ndarray, rule: tuple[float, float]) -> np.ndarray:
    share, distance = rule
    return np.minimum(share * np.maximum(top, 0), top - distance)


def set_rule(s: np.ndarray, asked: np.ndarray, lists: np.ndarray, target: float = TARGET) -> tuple[tuple[float, float], float, float]:
    """(rule, mean number of lists it probes, share of the neighbours in them) of queries' similarities ``s`` to the centroids
    and the (query, list) of their true neighbours: of both kinds of rule the narrowest that reaches the target, the cheaper one."""
    top = s.max(1)
    value = s[asked, lists]
    found = []
    for quantity in (value / np.maximum(top[asked], 1e-9), value - top[asked]):
        edge = float(np.quantile(quantity, 1 - target, method="lower")) - 1e-6 if len(value) else 0.0
        rule = (edge, 0.0) if not found else (1.0, -edge)
        inside = s >= _least(top, rule)[:, None]
        found.append((float(inside.sum(1).mean()), rule, float(inside[asked, lists].mean()) if len(value) else 1.0))
    # A share of a negative or small similarity reaches everything: such a rule is only as good as its count.
    cost, rule, share = min(found)
    return rule, cost, share


def scan(q: np.ndarray, q_id: np.ndarray, b: np.ndarray, b_id: np.ndarray, k: int, columns=COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, cosine) of the k best of ``b`` for each of ``q``; rows in double, equal ids left out."""
    dim = q.shape[1]
    un_q, un_b = q / np.linalg.norm(q, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    turn = rotation(dim)
    rq, rb = un_q.astype(np.float32) @ turn, un_b.astype(np.float32) @ turn
    ends = [c for c in columns if c < dim] + [dim]

    def block(start: int, end: int) -> np.ndarray:
        x, y = rq[:, start:end], rb[:, start:end]
        return np.einsum("nd,nd->n", x, x)[:, None] + np.einsum("nd,nd->n", y, y)[None, :] - 2 * (x @ y.T)

    def factor(d: int) -> float:
        return (1 + epsilon / np.sqrt(d)) ** 2 * d / dim if d < dim else 1.0

    part = block(0, ends[0])
    part[q_id[:, None] == b_id[None, :]] = np.inf
    kk = min(k, part.shape[1])
    seeds = np.argpartition(part, kk - 1, axis=1)[:, :kk]
    exact = 2 - 2 * np.einsum("qd,qkd->qk", rq, rb[seeds])
    exact[~np.isfinite(np.take_along_axis(part, seeds, 1))] = np.inf
    limit = exact.max(1) + 1e-4
    i, j = np.nonzero(part <= np.where(np.isfinite(limit), limit * factor(ends[0]), 1e9)[:, None])
    sofar = part[i, j]
    for a, e in zip(ends, ends[1:], strict=False):
        if len(i) > 0.04 * part.size:
            # So many are left that a product of whole blocks is cheaper than one by one.
            sofar = sofar + block(a, e)[i, j]
        else:
            for s in range(0, len(i), 50_000):
                diff = rq[i[s : s + 50_000], a:e] - rb[j[s : s + 50_000], a:e]
                sofar[s : s + 50_000] += np.einsum("nd,nd->n", diff, diff)
        keep = sofar <= limit[i] * factor(e) + 1e-4
        i, j, sofar = i[keep], j[keep], sofar[keep]
    # Of complete distances, what is beyond the k-th by more than their error needs no exact cosine.
    order = np.lexsort((sofar, i))
    i, j, sofar = i[order], j[order], sofar[order]
    first = np.searchsorted(i, np.arange(len(q)))
    last = np.minimum(first + k, np.searchsorted(i, np.arange(len(q)), side="right")) - 1
    close = sofar <= sofar[last[i]] + 1e-4 if len(i) else np.empty(0, dtype=bool)
    i, j = i[close], j[close]
    cos = np.empty(len(i))
    for s in range(0, len(i), 50_000):
        cos[s : s + 50_000] = np.einsum("nd,nd->n", un_q[i[s : s + 50_000]], un_b[j[s : s + 50_000]])
    order = np.lexsort((b_id[j], -cos, i))
    i, j, cos = i[order], j[order], cos[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    best = rank < k
    return i[best], j[best], cos[best]


def _sampled(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, v = matrix(batch.column(1), dim)
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed(v)] if len(v) else [], pa.binary())], names=["v"])


def _truth(batches: Iterator[pa.RecordBatch], dim: int, k: int, lists, asked) -> Iterator[pa.RecordBatch]:
    """Of a partition, the k most similar rows of each asked vector: (query, row, similarity, list of the row)."""
    ids, q = asked.value
    best = [np.full((len(q), k), -2.0, dtype=np.float32), np.full((len(q), k), -1, dtype=np.int64), np.full((len(q), k), -1, dtype=np.int64)]
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            at, v = matrix(part.column(1), dim)
            if not len(at):
                continue
            x, keys = unit(v), part.column(0).to_numpy()[at]
            s = q @ x.T
            s[ids[:, None] == keys[None, :]] = -2
            some = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            value = np.take_along_axis(s, some, 1)
            better = value > best[0][:, -1:]
            rows, inverse = np.unique(some[better], return_inverse=True)
            own = np.full(some.shape, -1, dtype=np.int64)
            if len(rows):
                own[better] = (x[rows] @ lists.value.T).argmax(1)[inverse]
            merged = [np.concatenate([b, n], axis=1) for b, n in zip(best, (np.where(better, value, -2), keys[some], own), strict=True)]
            order = np.argsort(-merged[0], axis=1, kind="stable")[:, :k]
            best = [np.take_along_axis(m, order, 1) for m in merged]
    query, _ = np.nonzero(best[0] > -2)
    real = best[0] > -2
    yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(best[1][real]), pa.array(best[0][real].astype(np.float64)), pa.array(best[2][real].astype(np.int32))], names=["query", "id", "s", "list"])


def _probed(batches: Iterator[pa.RecordBatch], dim: int, lists, rule: tuple[float, float]):
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            at, v = matrix(part.column(1), dim)
            if len(at):
                rows, found = probes(unit(v), lists.value, rule)
                own = np.ones(len(rows), dtype=bool)
                own[1:] = rows[1:] != rows[:-1]
                yield part.column(0).to_numpy()[at], packed(v), rows, found, own


def _counted(batches: Iterator[pa.RecordBatch], **how) -> Iterator[pa.RecordBatch]:
    total = None
    for _, _, _, found, own in _probed(batches, **how):
        n = len(how["lists"].value)
        both = np.stack([np.bincount(found[own], minlength=n), np.bincount(found, minlength=n)])
        total = both if total is None else total + both
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total[0]), dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], names=["list", "members", "askers"])


def _hashed(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _laid(batches: Iterator[pa.RecordBatch], tiles, **how) -> Iterator[pa.RecordBatch]:
    """Rows for each tile (list, candidate block, query block) that a vector has a part in; role 1 candidate, 2 query, 3 both."""
    for ids, half, rows, found, own in _probed(batches, **how):
        n_b, n_q = tiles.value[0][found], tiles.value[1][found]
        spot = _hashed(ids)[rows]
        b, q = spot % n_b, spot % n_q
        out = []
        plain = (n_b == 1) & (n_q == 1)
        at = np.flatnonzero(plain)
        out.append((at, np.zeros(len(at)), np.zeros(len(at)), np.where(own[at], 3, 2)))
        for x in np.flatnonzero(~plain).tolist():
            out.append(([x] * n_b[x], np.arange(n_b[x]), np.full(n_b[x], q[x]), np.full(n_b[x], 2)))
            if own[x]:
                out.append(([x] * n_q[x], np.full(n_q[x], b[x]), np.arange(n_q[x]), np.full(n_q[x], 1)))
        at, bb, qq, role = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))
        raw = [r.tobytes() for r in half]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found[at].astype(np.int32)),
                pa.array(bb.astype(np.int32)),
                pa.array(qq.astype(np.int32)),
                pa.array(role.astype(np.int8)),
                pa.array(ids[rows[at]]),
                pa.array([raw[r] for r in rows[at].tolist()], pa.binary()),
            ],
            names=["list", "b", "q", "role", "id", "v"],
        )


def _searched(rows: pa.Table, dim: int, k: int) -> pa.Table:
    role, ids = rows.column("role").to_numpy(), rows.column("id").to_numpy()
    v = np.frombuffer(b"".join(rows.column("v").to_pylist()), dtype=np.float16).reshape(-1, dim)
    base, ask = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    got: list[tuple] = []
    if len(base):
        b = v[base].astype(np.float64)
        for a in range(0, len(ask), 1000):
            at = ask[a : a + 1000]
            i, j, s = scan(v[at].astype(np.float64), ids[at], b, ids[base], k)
            got.append((ids[at][i], ids[base][j], s))
    if not got:
        return pa.table({"id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
    a, n, s = (np.concatenate(c) for c in zip(*got, strict=True))
    return pa.table({"id": a, "neighbour": n, "similarity": s})


def _alike(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """For each kind of equal vectors in a partition: how many rows, and the k + 1 least keys."""
    kinds, keys = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    counts = [np.empty(0, dtype=np.int64)]

    def reduced() -> None:
        h, i, n = (np.concatenate(x) for x in (kinds, keys, counts))
        order = np.lexsort((i, h))
        h, i, n = h[order], i[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
        rank = np.arange(len(h)) - np.repeat(first, np.diff(np.concatenate([first, [len(h)]])))
        # A kind's count is kept with its first row.
        total = np.zeros(len(h), dtype=np.int64)
        if len(h):
            total[first] = np.add.reduceat(n, first)
        few = rank <= k
        kinds[:], keys[:], counts[:] = [h[few]], [i[few]], [total[few]]

    size = 0
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            at, v = matrix(part.column(1), dim)
            kinds.append(_kinds(v) if len(at) else np.empty(0, dtype=np.int64))
            keys.append(part.column(0).to_numpy()[at])
            counts.append(np.ones(len(at), dtype=np.int64))
            size += len(at)
            if size > 1_000_000:
                reduced()
                size = 0
    reduced()
    yield pa.RecordBatch.from_arrays([pa.array(kinds[0]), pa.array(keys[0]), pa.array(counts[0])], names=["kind", "id", "n"])


def _kinds(v: np.ndarray) -> np.ndarray:
    """A hash of each vector, over all its numbers, that a power of two does not change."""
    _, e = np.frexp(np.abs(v).max(1))
    return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in np.ldexp(v, -e[:, None]) + 0.0], dtype=np.uint64).view(np.int64)


def _kept(batches: Iterator[pa.RecordBatch], dim: int, frequent) -> Iterator[pa.RecordBatch]:
    """The rows that take part in the search."""
    known = frequent.value
    for batch in batches:
        at, v = matrix(batch.column(1), dim)
        ids = batch.column(0).to_numpy()
        out = [r for r, h in zip(at.tolist(), _kinds(v).tolist() if len(at) else [], strict=True) if h not in known or ids[r] in known[h]]
        yield batch.take(pa.array(out, pa.int64()))


def _copies(batches: Iterator[pa.RecordBatch], dim: int, k: int, frequent) -> Iterator[pa.RecordBatch]:
    """The neighbours of the other rows of a kind: its k least keys."""
    known = {h: sorted(i)[:k] for h, i in frequent.value.items()}
    for batch in batches:
        at, v = matrix(batch.column(1), dim)
        ids = batch.column(0).to_numpy()
        who, whom = [], []
        for r, h in zip(at.tolist(), _kinds(v).tolist() if len(at) else [], strict=True):
            if h in known and ids[r] not in frequent.value[h]:
                who += [ids[r]] * k
                whom += known[h]
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(whom, pa.int64()), pa.array(np.ones(len(who)))], names=["id", "neighbour", "similarity"])


#: Kinds of more than k + 1 equal vectors that are handled apart; of more, the least frequent go through the search like any other.
KINDS = 50_000


def learned_lists(rows: DataFrame, n: int, dim: int, per_list: int = LIST, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of the lists for ``n`` rows (id, v), from a bounded sample of them."""
    wanted = number_of_lists(n, per_list)
    share = min(sample, max(LEAST_SAMPLE, PER_LIST * wanted)) / max(1, n)
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    drawn = [r.v for r in rows.where(part).mapInArrow(partial(_sampled, dim=dim), "v binary").collect()]
    if not drawn:  # no usable vector, or so few that none was drawn: one list
        return one_list(dim)
    x = unit(np.frombuffer(b"".join(drawn), dtype=np.float16).reshape(-1, dim).astype(np.float64))
    return centroids(x, max(1, min(wanted, len(x) // PER_LIST)))


def one_list(dim: int) -> np.ndarray:
    return np.ones((1, dim), dtype=np.float32) / np.sqrt(np.float32(dim))


def measured_rule(rows: DataFrame, n: int, dim: int, k: int, lists: np.ndarray, target: float = TARGET, asked: int = ASKED) -> tuple[tuple[float, float], float, float]:
    """What ``set_rule`` says of about ``asked`` rows and their true neighbours among all rows."""
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64("id", F.lit("asked")), F.lit(1 << 30)) < int(min(1.0, asked / max(1, n)) * (1 << 30))
    drawn = rows.where(part).mapInArrow(partial(_keyed, dim=dim), "id bigint, v binary").orderBy("id").collect()
    if not drawn:
        return (1.0, 0.0), 1.0, 1.0
    q = unit(np.frombuffer(b"".join(r.v for r in drawn), dtype=np.float16).reshape(-1, dim).astype(np.float64))
    shared = spark.sparkContext.broadcast((np.array([r.id for r in drawn]), q))
    heads = rows.mapInArrow(partial(_truth, dim=dim, k=k, lists=spark.sparkContext.broadcast(lists), asked=shared), "query int, id bigint, s double, list int")
    best = W.partitionBy("query").orderBy(F.desc("s"), "id")
    true = heads.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "list").collect()
    return set_rule(q @ lists.T, np.array([r.query for r in true], dtype=np.int64), np.array([r["list"] for r in true], dtype=np.int64), target)


def _keyed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, v = matrix(batch.column(1), dim)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in packed(v)] if len(v) else [], pa.binary())], names=["id", "v"])


def nearest(vectors: DataFrame, dim: int, k: int = 10, key: str = "vec_id", vector: str = "vector", target: float = TARGET, exact: bool = False, per_list: int = LIST, block: int = BLOCK) -> DataFrame:
    """(id, neighbour, similarity): the ``k`` most similar other vectors of every usable vector of ``dim`` entries."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where(f"id is not null and size(v) = {int(dim)}")
    n = vectors.count()
    alike = rows.mapInArrow(partial(_alike, dim=dim, k=k), "kind bigint, id bigint, n bigint")
    per_kind = alike.groupBy("kind").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids")).where(F.col("n") > k + 1)
    frequent = {r["kind"]: set(r["ids"]) for r in per_kind.orderBy(F.desc("n"), "kind").limit(KINDS).collect()}
    apart = None
    if frequent:
        shared = spark.sparkContext.broadcast(frequent)
        apart = rows.mapInArrow(partial(_copies, dim=dim, k=k, frequent=shared), "id bigint, neighbour bigint, similarity double")
        rows = rows.mapInArrow(partial(_kept, dim=dim, frequent=shared), "id bigint, v array<float>")
    out = "id bigint, neighbour bigint, similarity double"
    learned, rule = one_list(dim) if exact else learned_lists(rows, n, dim, per_list), (1.0, 0.0)
    if len(learned) > 1:
        rule, cost, _ = measured_rule(rows, n, dim, k, learned, target)
        if cost > EXACT_SHARE * len(learned):
            learned, rule = one_list(dim), (1.0, 0.0)
    how = {"dim": dim, "lists": spark.sparkContext.broadcast(learned), "rule": rule}
    counts = rows.mapInArrow(partial(_counted, **how), "list int, members bigint, askers bigint").groupBy("list").agg(F.sum("members").alias("m"), F.sum("askers").alias("a"))
    tiles = np.ones((2, len(learned)), dtype=np.int64)
    for r in counts.collect():  # one row for each list, of which there are SAMPLE / PER_LIST at most
        tiles[:, r.list] = max(1, -(-r.m // block)), max(1, -(-r.a // (2 * block)))
    laid = rows.mapInArrow(partial(_laid, tiles=spark.sparkContext.broadcast(tiles), **how), "list int, b int, q int, role tinyint, id bigint, v binary")

    def search(table: pa.Table) -> pa.Table:
        return _searched(table, dim, k)

    found = laid.groupBy("list", "b", "q").applyInArrow(search, out)
    best = W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    return found.unionByName(apart) if apart is not None else found


def pairs(neighbours: DataFrame) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs of which one is among the best of the other."""
    return neighbours.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()
