"""Reading level of documents from the levels of their sentences.

The running text of a document - without links, handles, log lines, figures and runs of one sign - is cut into
sentences, and what has no punctuation into windows of words. Every sentence gets a distribution over the levels from a
regularised softmax on hashed words and character n-grams and on word lengths (which languages share), trained with
numpy on the sentences of labelled documents (at most ``SAMPLE`` label rows, picked by a hash, the documents whole; labels err, so documents
that a model fitted without them contradicts are left out). A document's distribution is the softmax of the mean log
distribution of its sentences, weighted by their words and sharpened by a factor fitted to held-out labels.

Results of ``levels``: one row for each row with a key - probabilities of the levels, the expected level as difficulty,
the most likely level, and the words of running text. Documents under ``least`` words (null and empty ones too) have null levels.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.sentences import plain, spans

LEVELS, LEAST_WORDS, SAMPLE = 3, 40, 4_000
#: Of a labelled document, WINDOWS_EACH windows spread over the whole of it are fitted to, so that none outweighs the others.
BUCKETS, WINDOW, WINDOWS_EACH = 1 << 16, 24, 4
FOLDS, BATCH = 2, 64
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_LOG = re.compile(r"^\s*[\[(]?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|^\s*[{\[]\s*\"|^\s*(?:INFO|WARN|ERROR|DEBUG)\b")


def sentences(text: str) -> list[list[str]]:
    """The lower-cased words of each sentence of running text: without links and handles, lines of logs or figures, runs of one sign."""
    out = []
    text = plain(text)
    for a, b in spans(text):
        part = text[a:b].lower()
        found = _WORD.findall(part)
        if found and sum(map(len, found)) >= 0.5 * sum(map(len, part.split())) and not _LOG.search(text[a:b]):
            out.append([w for w in found if len(w) < 4 or w.count(w[0]) < len(w)])
    return out


def windows(text: str) -> list[list[str]]:
    """The words of each sentence of a text; long sentences in parts of WINDOW words, short ones joined."""
    out: list[list[str]] = []
    for w in sentences(text):
        if out and len(out[-1]) + len(w) <= WINDOW // 2:
            out[-1] += w
            continue
        for k in range(0, len(w), WINDOW):
            out.append(w[k : k + WINDOW])
    return [w for w in out if w]


def _grams(word: str) -> list[int]:
    framed = f"<{word}>"
    found = ["w" + word] + [framed[i : i + n] for n in (2, 3, 4) for i in range(len(framed) - n + 1)]
    return [xxhash.xxh32_intdigest(g.encode("utf-8", "replace")) % BUCKETS for g in found]


def _lengths(lengths: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Features of the word lengths of windows that begin at ``start``: shares of short, long and very long words, and the mean."""
    n = np.diff(np.concatenate([start, [len(lengths)]]))
    cols = [np.minimum(lengths, 16) / 8.0, lengths <= 4, lengths >= 8, lengths >= 12]
    return np.stack([np.add.reduceat(c.astype(float), start) / n for c in cols], 1)


class Model:
    """Softmax over the mean of bucket weights of a window's words and over its word lengths."""

    def __init__(self) -> None:
        self.t = np.zeros((BUCKETS, LEVELS), dtype=np.float32)
        self.d = np.zeros((5, LEVELS), dtype=np.float64)
        self.factor, self.known, self.rows = 1.0, {}, array("f")

    def _logs(self, mean: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = mean + np.concatenate([dense, np.ones((len(dense), 1))], 1) @ self.d
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, found: list[list[str]], y: np.ndarray, rounds: int = 6, rate: float = 0.3, decay: float = 1e-4) -> Model:
        rng = np.random.default_rng(8)
        known: dict[str, np.ndarray] = {}
        bags = []
        for w in found:
            parts = []
            for x in w:
                g = known.get(x)
                if g is None:
                    g = known[x] = np.array(_grams(x), dtype=np.int64)
                parts.append(g)
            n = np.array([len(p) for p in parts])
            bags.append((np.concatenate(parts), np.repeat(1 / n / len(n), n).astype(np.float32)))
        lengths = np.array([len(x) for w in found for x in w])
        start = np.concatenate([[0], np.cumsum([len(w) for w in found])[:-1]]).astype(np.int64)
        dense = _lengths(lengths, start)
        full = np.concatenate([dense, np.ones((len(dense), 1))], 1)
        weight = np.bincount(y, minlength=LEVELS).astype(float)
        weight = np.where(weight > 0, len(y) / np.maximum(weight, 1) / (weight > 0).sum(), 0)
        gt, gd = np.full(BUCKETS, 1e-8, dtype=np.float32), np.full_like(self.d, 1e-4)
        order, parts = rng.permutation(len(bags)), []
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            n = np.array([len(bags[i][0]) for i in at])
            ids, inverse = np.unique(np.concatenate([bags[i][0] for i in at]), return_inverse=True)
            parts.append((at, ids, inverse, np.concatenate([bags[i][1] for i in at]), np.repeat(np.arange(len(at)), n), np.concatenate([[0], np.cumsum(n)[:-1]])))
        for r in range(rounds):
            step = rate / (1 + r / 2)
            for k in rng.permutation(len(parts)).tolist():
                at, ids, inverse, share, owner, begin = parts[k]
                mean = np.add.reduceat(self.t[ids][inverse] * share[:, None], begin, axis=0)
                q = np.exp(self._logs(mean, dense[at]))
                q[np.arange(len(at)), y[at]] -= 1
                q *= weight[y[at]][:, None] / len(at)
                g = full[at].T @ q + decay * self.d
                gd += g**2
                self.d -= step * g / np.sqrt(gd)
                g = np.stack([np.bincount(inverse, q[owner, c] * share, len(ids)) for c in range(LEVELS)], 1) + decay * 0.1 * self.t[ids]
                gt[ids] += (g**2).sum(1)
                self.t[ids] -= (step * g / np.sqrt(gt[ids])[:, None]).astype(np.float32)
        return self

    def documents(self, texts: list[list[list[str]]]) -> np.ndarray:
        """The mean log distribution of the windows of each document, weighted by words; zeros for none."""
        out = np.zeros((len(texts), LEVELS))
        flat, counts, owner = [], [], []
        for k, found in enumerate(texts):
            for w in found:
                flat += w
                counts.append(len(w))
                owner.append(k)
        if not flat:
            return out
        if len(self.known) > 300_000:
            self.known, self.rows = {}, array("f")
        for w in set(flat) - self.known.keys():
            self.known[w] = len(self.rows) // LEVELS
            self.rows.extend(self.t[_grams(w)].mean(0).tolist())
        at = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        start = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        counts = np.array(counts)
        mean = np.add.reduceat(np.frombuffer(self.rows, dtype=np.float32).reshape(-1, LEVELS)[at], start, axis=0) / counts[:, None]
        lengths = np.array([len(w) for w in flat])
        logs = np.maximum(self._logs(mean, _lengths(lengths, start)), -8)
        total = np.stack([np.bincount(owner, logs[:, c] * counts, len(texts)) for c in range(LEVELS)], 1)
        return total / np.maximum(np.bincount(owner, counts, len(texts)), 1)[:, None]

    def distribution(self, mean: np.ndarray) -> np.ndarray:
        z = mean * self.factor
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _spread(found: list[list[str]], n: int = WINDOWS_EACH) -> list[list[str]]:
    return found if len(found) <= n else [found[i * len(found) // n] for i in range(n)]


def train(labelled: list[tuple[str, int]]) -> Model:
    """A model from (text, level)."""
    texts = [windows(t) for t, _ in labelled]
    some = [k for k, w in enumerate(texts) if w]
    y = np.array([labelled[k][1] - 1 for k in some], dtype=np.int64)
    texts = [texts[k] for k in some]
    if not len(y):
        return Model()

    def fitted(members: np.ndarray) -> Model:
        found, target = [], []
        for k in members.tolist():
            own = _spread(texts[k])
            found += own
            target += [y[k]] * len(own)
        return Model().fit(found, np.array(target)) if found else Model()

    every = np.arange(len(y))
    if len(y) < 12:
        return fitted(every)
    keep, best = np.ones(len(y), dtype=bool), 1.0
    fold = np.random.default_rng(4).permutation(len(y)) % FOLDS
    held = np.zeros((len(y), LEVELS))
    for f in range(FOLDS):
        m = fitted(every[fold != f])
        held[fold == f] = m.documents([_spread(texts[k]) for k in every[fold == f]])
    keep = held[every, y] > held.max(1) - 2.0
    scale = [0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0]
    fit = []
    for s in scale:
        z = held * s
        z -= np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) + z.max(1, keepdims=True)
        fit.append(np.maximum(z[every, y], -6).mean())
    best = scale[int(np.argmax(fit))]
    model = fitted(every[keep] if keep.any() else every)
    model.factor = best
    return model


SCHEMA = "doc_id bigint, n_words int, p1 double, p2 double, p3 double"


def _leveled(batches: Iterator[pa.RecordBatch], model, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            found = [windows(t) if t else [] for t in part.column(1).to_pylist()]
            n = np.array([sum(map(len, w)) for w in found])
            p = model.value.distribution(model.value.documents(found))
            few = n < least
            columns = [pa.array(p[:, c], mask=few) for c in range(LEVELS)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int32)), *columns], names=["doc_id", "n_words", "p1", "p2", "p3"])


def levels(documents: DataFrame, labels: DataFrame, least: int = LEAST_WORDS, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_words, p1, p2, p3, difficulty, reading_level) of every document."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    share = int(min(1.0, sample / max(1, labels.count())) * (1 << 20))
    drawn = labels.where(F.col("reading_level").between(1, LEVELS) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share))
    voted = drawn.groupBy("doc_id").agg(F.expr("cast(percentile_approx(reading_level, 0.5) as int)").alias("y"))
    picked = rows.join(F.broadcast(voted), "doc_id").where("text is not null").orderBy("doc_id").collect()
    model = spark.sparkContext.broadcast(train([(r["text"], r["y"]) for r in picked]))
    found = rows.mapInArrow(partial(_leveled, model=model, least=least), SCHEMA)
    level = F.when(F.col("p1").isNotNull(), F.when((F.col("p1") >= F.col("p2")) & (F.col("p1") >= F.col("p3")), 1).when(F.col("p2") >= F.col("p3"), 2).otherwise(3))
    return found.withColumn("difficulty", F.col("p1") + 2 * F.col("p2") + 3 * F.col("p3")).withColumn("reading_level", level)
