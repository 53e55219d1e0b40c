"""Near-duplicate texts: pairs whose sets of word shingles have at least ``threshold`` of their union in common.

A text is a binary vector with a bit for each shingle of the corpus. The bits are grouped into PARTITIONS: every shingle
belongs to the partition of its anchor, the word of least hash among its words. Neighbouring shingles mostly share their
anchor, so bits that one edit changes together, and that occur together elsewhere, lie in one partition.

Of a pair that passes, the smaller text (n bits) lacks at most d = n - ceil(2t / (1 + t) n) of its bits in the larger one. By the
generalised pigeonhole principle, thresholds r_i - 1 of the partitions with sum r_i = d + 1 leave some partition in
which no more than its threshold are lacking, so the larger text holds one of any r_i of that partition's bits. For each text
dynamic programming over the partitions picks the r_i (0 for a partition that is not probed) of least estimated cost.
What a partition costs at r_i: its r_i rarest bits are probed; their candidates are estimated from counts of every bit over
the whole corpus (two-row counting sketch of fixed size), where bits of one anchor are taken to meet the same texts and
count by the greatest of them. That makes the cost curves bend either way, so no greedy order would do.

The smaller text probes, every text is indexed with all its bits that anyone may probe for. Postings of a bit of
more than BLOCK texts are tiled by blocks of both sides. A candidate's sizes and parity signatures bound its
similarity in the join; what is left is verified on the sets themselves, so the result is exact (up to 64-bit hashes).

Copies (equal sets) form one class; candidates are sought between classes only. Results:

* ``pairs`` - (id_a, id_b), id_a < id_b: every pair of the definition, copies included; null ids and texts under ``least`` words have none;
* ``named_links`` - (id_a, id_b): the pairs between classes, each class named by its least id;
* ``classes`` - one row for each text with enough words: its class and its number of links to other classes;
* ``groups`` - one row for each such text: the least id of the texts that links connect it with;
* rows with an equal id and text count once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.sources.tables import stored

LEAST_WORDS, SHINGLE, THRESHOLD = 20, 4, 0.5
ROWS, BITS, CHUNK = 2, 23, 1 << 18
#: Partitions of the bits, and the units that a text's sum of thresholds is divided among them in (of several bits in long texts).
PARTITIONS, UNITS = 16, 32
#: What posting a bit costs, in candidates.
POSTING = 0.25
#: Cells of the counts of probes and postings, and the rows of a posting list or a class that are joined in one block.
CELLS, BLOCK = 22, 4096
#: Words of 64 bits of a set's parity signature.
SIGNATURE = 2
SIGNS = [f"s{w}" for w in range(SIGNATURE)]
_WORD = re.compile(r"[^\W_]+")
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M[0]
    h = (h ^ (h >> np.uint64(29))) * _M[1]
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sets of shingle hashes of a batch of texts as flat sorted arrays."""

    def __init__(self, least: int = LEAST_WORDS, size: int = SHINGLE):
        self.least, self.size, self.known = max(least, size), size, {}

    def _hash(self, word: str) -> int:
        h = self.known.get(word)
        if h is None:
            if len(self.known) > 200_000:
                self.known.clear()
            h = self.known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def __call__(self, texts: list[str | None], anchors: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """(text number of each set, its bounds in the flat array as n+1 offsets, the flat array; the anchor of each shingle)."""
        of, counts, flat = [], [], []
        for k, t in enumerate(texts):
            if t:
                words = _WORD.findall(t.lower())
                if len(words) >= self.least:
                    of.append(k)
                    counts.append(len(words))
                    flat += map(self._hash, words)
        if not of:
            none = np.empty(0, dtype=np.uint64)
            return np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int64), none, none
        words, counts = np.array(flat, dtype=np.uint64), np.array(counts)
        owner = np.repeat(np.arange(len(of)), counts)
        m = len(words) - self.size + 1
        h = np.zeros(m, dtype=np.uint64)
        for j in range(self.size):
            h = _mix(h + words[j : j + m] * _M[2] + _M[3])
        own = owner[:m] == owner[self.size - 1 :]
        h, owner = h[own], owner[:m][own]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        anchor = None
        if anchors:
            mixed = _mix(words * _M[1])
            anchor = np.minimum.reduce([mixed[j : j + m] for j in range(self.size)])[own][order][new]
        h, owner = h[new], owner[new]
        return np.array(of), np.searchsorted(owner, np.arange(len(of) + 1)), h, anchor


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    return (_mix(h + _M[row]) >> np.uint64(64 - BITS)).astype(np.int64)


def _chunks(total: np.ndarray) -> pa.RecordBatch:
    """Counters of a partition, in compressed chunks."""
    parts = total.reshape(-1, CHUNK)
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), _part(len(parts)), pa.array([_squeezed(p) for p in parts])], names=["chunk", "part", "counters"])


def _counts(batches: Iterator[pa.RecordBatch], least: int, size: int) -> Iterator[pa.RecordBatch]:
    """Counters of the shingles of a partition."""
    shingler, total, held, n = Shingler(least, size), None, [], 0

    def add() -> None:
        nonlocal total, held, n
        h = np.concatenate(held)
        if total is None:
            total = np.zeros((ROWS, 1 << BITS), dtype=np.uint32)
        for r in range(ROWS):
            np.add(total[r], np.bincount(_cells(h, r), minlength=1 << BITS), out=total[r], casting="unsafe")
        held, n = [], 0

    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            h = shingler(batch.column(1).slice(k, 2000).to_pylist())[2]
            held.append(h)
            n += len(h)
            if n > 2_000_000:
                add()
    if n:
        add()
    if total is not None:
        yield _chunks(total)


def _squeezed(values: np.ndarray) -> bytes:
    """Counters as bytes where they fit, compressed."""
    return zlib.compress((values.astype(np.uint8) if values.max(initial=0) < 256 else values.astype(np.uint32)).tobytes(), 6)


def _counters(raw: bytes) -> np.ndarray:
    raw = zlib.decompress(raw)
    return np.frombuffer(raw, dtype=np.uint8 if len(raw) == CHUNK else np.uint32)


def _part(n: int) -> pa.Array:
    return pa.array([TaskContext.get().partitionId()] * n, pa.int32())


def _chunk(key: tuple, name: str, value: bytes) -> pa.Table:
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), name: pa.array([value])})


def _sum(key: tuple, parts: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, dtype=np.uint64)
    for c in parts.column("counters"):
        total += _counters(c.as_py())
    return _chunk(key, "counters", _squeezed(np.minimum(total, 2**32 - 1)))


def scaled(count: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact up to 16, beyond in steps of a sixteenth power of two."""
    with np.errstate(divide="ignore"):
        big = 16 + np.floor((np.log2(np.maximum(count, 1).astype(float)) - 4) * 8)
    return np.where(count <= 16, count, np.minimum(big, 255)).astype(np.uint8)


#: Partial results that one task merges at most.
FAN_IN = 64


def merged(parts: DataFrame, merge, value: str, n_parts: int) -> DataFrame:
    """Merge the parts of each chunk by a tree, so that no task holds more than FAN_IN of them."""
    schema = f"chunk int, part int, {value} binary"
    while True:
        parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("chunk", "part").applyInArrow(merge, schema)
        n_parts = -(-n_parts // FAN_IN)
        if n_parts <= 1:
            return parts


def _gathered(parts: DataFrame, n_parts: int, rows: int, cells: int) -> np.ndarray:
    """Summed counters as bytes: rows x cells, whatever the corpus."""
    out = np.zeros(rows * cells, dtype=np.uint8)
    for r in merged(parts, _sum, "counters", n_parts).collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = scaled(_counters(r.counters))
    return out.reshape(rows, -1)


def counting_sketch(contents: DataFrame, least: int = LEAST_WORDS, size: int = SHINGLE) -> np.ndarray:
    """Counts of every shingle over all texts, never below the true ones: ROWS x 2**BITS bytes whatever the corpus."""
    parts = contents.mapInArrow(partial(_counts, least=least, size=size), "chunk int, part int, counters binary")
    return _gathered(parts, contents._jdf.rdd().getNumPartitions(), ROWS, 1 << BITS)


def _estimate(sketch: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.minimum.reduce([sketch[r][_cells(h, r)] for r in range(ROWS)])


#: About the counts that ``scaled`` bytes stand for, never below them.
UNSCALED = np.where(np.arange(256) <= 16, np.arange(256), np.ceil(2.0 ** (4 + (np.arange(256) - 15) / 8)))


def allocate(counts: np.ndarray, h: np.ndarray, anchor: np.ndarray, bounds: np.ndarray, threshold: float) -> np.ndarray:
    """Which bits each text probes for: the rarest of each partition, as many as the text's thresholds say (see above)."""
    n = np.diff(bounds)
    texts, owner = len(n), np.repeat(np.arange(len(n)), n)
    chosen = np.zeros(len(h), dtype=bool)
    if not len(h):
        return chosen
    need = n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + 1
    # Bits that no other text has cost nothing: all are taken, and where they suffice nothing is left to allocate.
    free = counts <= 1
    need -= np.bincount(owner[free], minlength=texts)
    some = need > 0
    if not some.all() or free.any():
        rest = np.flatnonzero(~free & some[owner])
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[rest], minlength=texts)[some])])
        chosen[free] = True
        chosen[rest] = _allocated(counts[rest], h[rest], anchor[rest], bounds, need[some])
        return chosen
    return _allocated(counts, h, anchor, bounds, need)


def _allocated(counts: np.ndarray, h: np.ndarray, anchor: np.ndarray, bounds: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The dynamic program of ``allocate`` over bits that other texts have; ``need`` is positive."""
    n = np.diff(bounds)
    texts, owner = len(n), np.repeat(np.arange(len(n)), n)
    chosen = np.zeros(len(h), dtype=bool)
    if not len(h):
        return chosen
    unit = -(-need // UNITS)
    slots = -(-need // unit)
    group = owner * PARTITIONS + (anchor % np.uint64(PARTITIONS)).astype(np.int64)
    others = np.maximum(UNSCALED[counts] - 1, 0)
    order = np.lexsort((h, counts, group))
    # Of an anchor's bits, each further one adds only what it counts more than the one before.
    place = np.empty(len(h), dtype=np.int64)
    place[order] = np.arange(len(h))
    by_anchor = np.lexsort((place, anchor, group))
    same = (group[by_anchor][1:] == group[by_anchor][:-1]) & (anchor[by_anchor][1:] == anchor[by_anchor][:-1])
    more = others[by_anchor].copy()
    more[1:] -= np.where(same, others[by_anchor][:-1], 0)
    cost = np.empty(len(h))
    cost[by_anchor] = more
    total = np.concatenate([[0.0], np.cumsum((cost + POSTING * (others > 0))[order])])
    first = np.searchsorted(group[order], np.arange(texts * PARTITIONS + 1))
    size = np.diff(first).reshape(texts, PARTITIONS)
    start = first[:-1].reshape(texts, PARTITIONS)
    # best[t, k]: the least cost of k units in the partitions so far.
    best = np.full((texts, UNITS + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((PARTITIONS, texts, UNITS + 1), dtype=np.int8)
    for i in range(PARTITIONS):
        new = best.copy()
        for j in range(1, min(UNITS, int((size[:, i] // unit).max())) + 1):
            full = j * unit <= size[:, i]
            price = np.where(full, total[start[:, i] + np.where(full, j * unit, 0)] - total[start[:, i]], np.inf)
            offer = best[:, :-j] + price[:, None]
            better = offer < new[:, j:]
            new[:, j:] = np.where(better, offer, new[:, j:])
            took[i][:, j:] = np.where(better, j, took[i][:, j:])
        best = new
    every, left = np.arange(texts), slots.copy()
    impossible = ~np.isfinite(best[every, slots])  # too many partitions under one unit: all bits are probed
    taken = np.zeros((texts, PARTITIONS), dtype=np.int64)
    for i in range(PARTITIONS - 1, -1, -1):
        taken[:, i] = took[i][every, left]
        left = left - taken[:, i]
    rank = np.arange(len(h)) - first[group[order]]
    chosen[order] = rank < (taken * unit[:, None]).ravel()[group[order]]
    return chosen | impossible[owner]


def _class_of(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(h))])
    n = np.diff(bounds).astype(np.uint64)
    return _mix(total[bounds[1:]] - total[bounds[:-1]] + n * _M[3]).astype(np.int64)


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set, of SIGNATURE * 64 parities: how often, modulo 2, a shingle falls to each.

    Two sets' signatures differ in no more bits than the sets differ in shingles.
    """
    where = _mix(h ^ _M[1]) % np.uint64(64 * SIGNATURE)
    out = np.zeros((len(bounds) - 1, SIGNATURE), dtype=np.uint64)
    filled = np.flatnonzero(np.diff(bounds))
    for w in range(SIGNATURE):
        bit = np.where(where >> np.uint64(6) == w, np.uint64(1) << (where & np.uint64(63)), np.uint64(0))
        if len(filled):
            out[filled, w] = np.bitwise_xor.reduceat(bit, bounds[:-1][filled])
    return out.view(np.int64)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _members(batches: Iterator[pa.RecordBatch], sketch, least: int, size: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """One row for each text: its class, and its bits that other texts have, those it probes for first."""
    shingler = Shingler(least, size)
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            of, bounds, h, anchor = shingler(part.column(1).to_pylist(), True)
            counts = _estimate(sketch.value, h)
            shared = counts > 1  # a bit counted once is in no other text
            probe = allocate(counts, h, anchor, bounds, threshold) & shared
            owner = np.repeat(np.arange(len(of)), np.diff(bounds))
            order = np.lexsort((~probe, owner))
            order = order[shared[order]]
            upto, probes = (np.concatenate([[0], np.cumsum(x)])[bounds] for x in (shared, probe))
            # Half of a hash is enough to meet by; what meets is verified.
            bits = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array((h[order] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            signs = signatures(h, bounds)
            arrays = [part.column(0).take(pa.array(of)), pa.array(_class_of(h, bounds)), pa.array(np.diff(bounds).astype(np.int32)), bits, pa.array(np.diff(probes).astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in signs.T)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "cls", "n", "bits", "probes", *SIGNS])


def _flat(bits: pa.Array, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, row of each, whether it is a probe) of lists of bits."""
    n = np.diff(bits.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return bits.flatten().to_numpy(), row, place < probes[row]


def _cell(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.view(np.uint32).astype(np.uint64) * _M[0]) >> np.uint64(64 - CELLS)).astype(np.int64)


def _demand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many classes of a partition probe for, and have, the bits of each cell."""
    total = np.zeros((2, 1 << CELLS), dtype=np.uint32)
    for batch in batches:
        keys, _, probe = _flat(batch.column(0), batch.column(1).to_numpy())
        cell = _cell(keys)
        total[0] += np.bincount(cell[probe], minlength=1 << CELLS).astype(np.uint32)
        total[1] += np.bincount(cell, minlength=1 << CELLS).astype(np.uint32)
    yield _chunks(total)


def _posted(batches: Iterator[pa.RecordBatch], demand, probing: bool, block: int) -> Iterator[pa.RecordBatch]:
    """(key, tile, class, size, signature): the probes, or the postings that a probe may meet; of a hot bit once for each tile."""
    asked, held = demand.value
    for batch in batches:
        for k in range(0, batch.num_rows, 20_000):
            part = batch.slice(k, 20_000)
            keys, row, probe = _flat(part.column(2), part.column(3).to_numpy())
            cell = _cell(keys)
            wanted = np.flatnonzero((asked[cell] > 0) & (held[cell] > 1) & (probe if probing else True))
            keys, row, cell = keys[wanted], row[wanted], cell[wanted]
            across, down = (np.maximum(1, np.ceil(UNSCALED[x[cell]] / block)).astype(np.int64) for x in (asked, held))
            spot = (_mix(part.column(0).to_numpy().view(np.uint64)) >> np.uint64(20)).astype(np.int64)[row]
            own, copies = (spot % across * down, down) if probing else (spot % down, across)
            at = np.repeat(np.arange(len(keys)), copies)
            number = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            tile = own[at] + number * (1 if probing else down[at])
            rows = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(tile), *(part.column(c).take(rows) for c in (0, 1, *range(4, 4 + SIGNATURE)))], names=["key", "tile", "cls", "n", *SIGNS])


def _bits_of(batches: Iterator[pa.RecordBatch], log2: int) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << log2, dtype=bool)
    for batch in batches:
        for c in range(batch.num_columns):
            seen[_mix(batch.column(c).to_numpy().view(np.uint64)) >> np.uint64(64 - log2)] = True
    parts = np.packbits(seen).reshape(-1, CHUNK >> 3)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), _part(len(parts)), pa.array([zlib.compress(p.tobytes(), 1) for p in parts])], names=["chunk", "part", "bits"])


def _or(key: tuple, parts: pa.Table) -> pa.Table:
    out = np.zeros(CHUNK >> 3, dtype=np.uint8)
    for c in parts.column("bits"):
        out |= np.frombuffer(zlib.decompress(c.as_py()), dtype=np.uint8)
    return _chunk(key, "bits", zlib.compress(out.tobytes(), 6))


def membership_filter(longs: DataFrame, log2: int = 23) -> np.ndarray:
    """A bitmap of 2**log2 bits in which the hash of every value of ``longs`` is set."""
    summed = merged(longs.mapInArrow(partial(_bits_of, log2=log2), "chunk int, part int, bits binary"), _or, "bits", longs._jdf.rdd().getNumPartitions())
    out = np.zeros(1 << (log2 - 3), dtype=np.uint8)
    for r in summed.collect():
        out[r.chunk * (CHUNK >> 3) : (r.chunk + 1) * (CHUNK >> 3)] = np.frombuffer(zlib.decompress(r.bits), dtype=np.uint8)
    return np.unpackbits(out).astype(bool)


def _sets(batches: Iterator[pa.RecordBatch], wanted, least: int, size: int) -> Iterator[pa.RecordBatch]:
    """(class, set) of the texts whose id may be wanted."""
    shingler = Shingler(least, size)
    bits = wanted.value
    shift = np.uint64(64 - (len(bits).bit_length() - 1))
    for batch in batches:
        keep = np.flatnonzero(bits[_mix(batch.column(0).to_numpy().view(np.uint64)) >> shift])
        for k in range(0, len(keep), 2000):
            _, bounds, h, _ = shingler(batch.column(1).take(pa.array(keep[k : k + 2000])).to_pylist())
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(_signed(h)))
            yield pa.RecordBatch.from_arrays([pa.array(_class_of(h, bounds)), sets], names=["cls", "shingles"])


def message_contents(messages: DataFrame) -> DataFrame:
    """(id, content): the text, or the caption where the text is null or blank."""
    # Blank: white space of any script only.
    filled = F.col("text").rlike(r"[^\s\x0B\x1C-\x1F\x85\p{Z}]")
    return messages.select("id", F.when(filled, F.col("text")).otherwise(F.col("caption")).alias("content")).where("id is not null and content is not null")


class NearDuplicates:
    """Candidates, links, classes and groups over (id, content)."""

    def __init__(self, contents: DataFrame, least: int = LEAST_WORDS, size: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK):
        self.contents, self.how = contents.select("id", "content"), {"least": least, "size": size}
        self.spark: SparkSession = contents.sparkSession
        self.threshold, self.block = threshold, block
        sketch = self.spark.sparkContext.broadcast(counting_sketch(self.contents, **self.how))
        id_type = self.contents.schema["id"].dataType.simpleString()
        signs = ", ".join(f"{s} bigint" for s in SIGNS)
        rows = self.contents.mapInArrow(partial(_members, sketch=sketch, threshold=threshold, **self.how), f"id {id_type}, cls bigint, n int, bits array<int>, probes int, {signs}")
        self.rows = stored(rows)
        self.members = self.rows.select("id", "cls").distinct()
        sets = stored(self.rows.drop("id").dropDuplicates(["cls"]))
        counted = sets.select("bits", "probes").mapInArrow(_demand, "chunk int, part int, counters binary")
        demand = self.spark.sparkContext.broadcast(_gathered(counted, sets._jdf.rdd().getNumPartitions(), 2, 1 << CELLS))
        posting = f"key int, tile bigint, cls bigint, n int, {signs}"
        sets = sets.select("cls", "n", "bits", "probes", *SIGNS)
        a, b = (sets.mapInArrow(partial(_posted, demand=demand, probing=p, block=block), posting).select("key", "tile", *[F.col(c).alias(c + x) for c in ("cls", "n", *SIGNS)]) for p, x in ((True, "a"), (False, "b")))
        smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("clsa") < F.col("clsb")))
        # The signatures bound how much the sets differ; most candidates need no look at the sets.
        apart = sum((F.bit_count(F.col(s + "a").bitwiseXOR(F.col(s + "b"))) for s in SIGNS), F.lit(0))
        most = (F.col("na") + F.col("nb")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)
        fits = smaller & (F.col("na") >= F.col("nb") * F.lit(threshold)) & (apart <= most)
        self.candidates = stored(a.join(b, ["key", "tile"]).where(fits).select(F.col("clsa").alias("a"), F.col("clsb").alias("b")).distinct())

    def links(self) -> DataFrame:
        """(a, b): pairs of classes whose sets pass the threshold."""
        involved = self.candidates.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        named = self.rows.select("id", "cls").join(involved, "cls").groupBy("cls").agg(F.min("id").alias("id"))
        wanted = self.spark.sparkContext.broadcast(membership_filter(named.select(F.xxhash64("id"))))
        texts = self.contents.select(F.xxhash64("id"), "content")
        sets = texts.mapInArrow(partial(_sets, wanted=wanted, **self.how), "cls bigint, shingles array<bigint>").dropDuplicates(["cls"])
        pairs = self.candidates.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return pairs.where(common >= F.lit(self.threshold) * (F.size("sa") + F.size("sb") - common)).select("a", "b")

    def pairs(self) -> DataFrame:
        """(id_a, id_b) of every pair, members of one class included."""
        # Classes of more than a block of members, at most one for each block of texts, are tiled by blocks.
        hot = self.members.groupBy("cls").count().where(F.col("count") > self.block).select("cls", F.ceil(F.col("count") / self.block).alias("blocks"))
        m = self.members.join(F.broadcast(hot), "cls", "left").select("cls", "id", F.coalesce("blocks", F.lit(1)).alias("blocks"))
        m = m.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
        x = m.select("cls", F.col("id").alias("ia"), F.col("block").alias("i"), others.alias("j"))
        y = m.select("cls", F.col("id").alias("ib"), others.alias("i"), F.col("block").alias("j"))
        within = x.join(y, ["cls", "i", "j"]).where("ia < ib")
        tiled = self.links()
        for side in "ab":
            blocks = hot.select(F.col("cls").alias(side), F.col("blocks"))
            tiled = tiled.join(F.broadcast(blocks), side, "left").withColumn(f"block_{side}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        of_a, of_b = (m.select(F.col("cls").alias(s), F.col("block").alias(f"block_{s}"), F.col("id").alias(f"i{s}")) for s in "ab")
        across = tiled.join(of_a, ["a", "block_a"]).join(of_b, ["b", "block_b"])
        every = across.select("ia", "ib").unionByName(within.select("ia", "ib")).where("ia <> ib")
        return every.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))

    def _names(self) -> DataFrame:
        return self.members.groupBy("cls").agg(F.min("id").alias("class_id"))

    def named_links(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: the pairs between classes, named by the least id of each."""
        names = self._names()
        a, b = (names.select(F.col("cls").alias(s), F.col("class_id").alias(f"i{s}")) for s in "ab")
        return self.links().join(a, "a").join(b, "b").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))

    def classes(self) -> DataFrame:
        """(id, class_id, n_links): the least id of the text's class and how many other classes it is linked to."""
        links = self.links()
        degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n_links"))
        return self.members.join(self._names(), "cls").join(degree, "cls", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def groups(self) -> DataFrame:
        """(id, group_id): the least id of all texts that copies and links, over however many steps, connect with the text."""
        links = self.links()
        edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        label = edges.groupBy("a").agg(F.min("b").alias("l")).select("a", F.least("a", "l").alias("l"))
        while True:
            # The least label among neighbours, then the label of that label: paths halve in every round.
            label = stored(label)
            heard = edges.join(label.select(F.col("a").alias("b"), "l"), "b").select("a", "l").unionByName(label).groupBy("a").agg(F.min("l").alias("l"))
            jumped = heard.join(heard.select(F.col("a").alias("l"), F.col("l").alias("further")), "l", "left").select("a", F.least("l", "further").alias("l"))
            after = stored(jumped)
            if after.join(label, ["a", "l"], "left_anti").isEmpty():
                break
            label = after
        labelled = self.members.join(label.select(F.col("a").alias("cls"), "l"), "cls", "left").select("id", F.coalesce("l", "cls").alias("l"))
        return labelled.join(labelled.groupBy("l").agg(F.min("id").alias("group_id")), "l").select("id", "group_id")
