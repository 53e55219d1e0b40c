"""Scores of abusive, hateful or sexual content, by bags of subword embeddings.

Words are brought to a plain form (disguises by digits, signs, foreign look-alikes, repeated or spaced letters are
undone as far as they can be), and every word, its character n-grams and every pair of neighbouring words are hashed
to embeddings that a window - a sentence, or a dozen words of a long one - averages; a linear softmax on the average
tells abusive windows from others. Both are trained together with numpy, so that an unseen misspelling shares the
vectors of most of its n-grams. An average counts ``PRIOR`` empty n-grams besides its own, and what was never trained is
zero: a window of few or unseen n-grams stays near the constant, which says no.

Fitted to at most ``SAMPLE`` label rows and the messages of about ``PRESUMED`` unlabelled ones, presumed harmless, both
picked by a hash. A label holds for a message, not for a window. A first model takes every window for what its message
is labelled; after that the window that a model fitted without it finds worst stands for a message labelled abusive.
Labels and presumptions that such a model clearly contradicts are left out (annotators err), so are messages on which as
many annotators say yes as no.

As the softmax is linear in the average, a word's n-grams come down to one sum and one count, which are kept by word.

Results of ``scores``: one row for each message id - the score in [0, 1] of its worst window in text or caption, which
field holds it, and whether it passes the threshold. Null and empty fields score 0; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.sentences import plain, spans

SAMPLE, PRESUMED, THRESHOLD = 8_000, 3_000, 0.6
BUCKETS, WIDTH, PRIOR = 1 << 17, 4, 40
ROUNDS, BATCH = 6, 128
#: Windows of a harmless message, besides its worst, that a round learns from.
OTHERS = 2
#: Longer sentences are scored by windows of so many words, each beginning STRIDE words after the last.
LONG, SPAN, STRIDE, LEAST_TOKENS = 16, 12, 4, 3
#: Log-odds under which a label of abuse (of a window that is usual elsewhere), and over which one of harmlessness, is taken for an error.
LEAST_ODDS, MOST_ODDS, TURNS = 0.0, 0.0, 2
#: Words and pairs that so many harmless messages have are usual; what being usual takes from a window's log-odds when the worst is sought.
USUAL, UNUSUAL = 3, 3.0
#: Letters that digits and signs stand for in disguised words.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "!": "i", "|": "l"})
#: Cyrillic letters that look like Latin ones.
_ALIKE = str.maketrans(dict(zip("асеорхукіѕјтмнвг", "aceopxykisjtmhbr", strict=True)))
_TOKEN = re.compile(r"[^\s.,;:?…()\[\]{}«»„“”\"]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
_SINGLE = re.compile(r" \w[ .\-_*]\w[ .\-_*]\w[ .\-_*]")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_LATIN, _CYRILLIC = re.compile("[a-z]"), re.compile("[Ѐ-ӿ]")


@lru_cache(maxsize=200_000)
def normal(word: str) -> str:
    """The plain form of a lower-cased word."""
    if not word.isalpha():
        core = word.strip("!'’-–—_~+=<>/\\&%#|")
        if any(c.isalpha() for c in core) and (any(c.isdigit() for c in core) or not core.replace("-", "").replace("'", "").isalpha()):
            word = core.translate(_LEET)
        else:
            word = core
    if _LATIN.search(word) and _CYRILLIC.search(word):
        word = word.translate(_ALIKE)
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("ß", "ss")
    out = re.sub(r"(.)\1{2,}", r"\1", word)
    return out if any(c.isalpha() for c in out) else ""


def _joined(text: str) -> str:
    """A lower-cased text without invisible signs, spaced-out words joined."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text) if _SINGLE.search(text) else text


def sentences(text: str) -> list[list[str]]:
    """The tokens of each sentence of a lower-cased text; one of fewer than LEAST_TOKENS belongs to the next, or to the one before."""
    out: list[list[str]] = []
    open_ = False
    for a, b in spans(text):
        found = _TOKEN.findall(text, a, b)
        if found:
            if open_:
                out[-1] += found
            else:
                out.append(found)
            open_ = len(out[-1]) < LEAST_TOKENS
    if open_ and len(out) > 1:
        last = out.pop()
        out[-1] += last
    return out


def _bucket(text: str) -> int:
    return xxhash.xxh32_intdigest(text.encode("utf-8", "replace")) % BUCKETS


def grams(word: str) -> list[int]:
    """Buckets of a word and its n-grams of 3 to 5 signs."""
    framed = f"<{word}>"
    out = [_bucket("w" + word)]
    for n in (3, 4, 5):
        out += [_bucket(framed[i : i + n]) for i in range(len(framed) - n + 1)]
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(BUCKETS)).astype(np.int32)


def features(sentence: list[str], known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a window's n-grams, words and pairs of neighbours; and of its words and pairs alone."""
    parts = []
    for w in sentence:
        g = known.get(w)
        if g is None:
            g = known[w] = np.array(grams(w), dtype=np.int32)
        parts.append(g)
    heads = np.array([p[0] for p in parts], dtype=np.int32)
    if len(heads) > 1:
        pairs = _pair(heads[:-1], heads[1:])
        parts.append(np.repeat(pairs, 3))  # a pair weighs as three n-grams
        return np.concatenate(parts), np.concatenate([heads, pairs])
    return np.concatenate(parts), heads


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of the windows of a sentence of n words."""
    if n <= LONG:
        return [(0, n)] if n else []
    return [(min(k * STRIDE, n - SPAN), min(k * STRIDE, n - SPAN) + SPAN) for k in range(-(-(n - SPAN) // STRIDE) + 1)]


class Model:
    """Embeddings of buckets and a linear softmax, trained together."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.e = (rng.standard_normal((BUCKETS, WIDTH)) * 0.05).astype(np.float32)
        self.w = np.zeros((WIDTH, 2), dtype=np.float32)
        self.w[:, 1] = rng.standard_normal(WIDTH) * 0.5
        self.b = np.zeros(2, dtype=np.float32)
        self.seen = np.zeros(BUCKETS, dtype=bool)

    def fit(self, bags: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.5, seed: int = 2) -> Model:
        rng = np.random.default_rng(seed)
        ge, gw, gb = np.full(BUCKETS, 1e-6, dtype=np.float32), np.full_like(self.w, 1e-3), np.full_like(self.b, 1e-3)
        order = rng.permutation(len(bags))
        parts = []
        for a in range(0, len(bags), BATCH):
            at = order[a : a + BATCH]
            n = np.array([len(bags[i]) for i in at])
            flat = np.concatenate([bags[i] for i in at])
            ids, inverse = np.unique(flat, return_inverse=True)
            self.seen[ids] = True
            parts.append((y[at], n + PRIOR, flat, np.repeat(np.arange(len(at)), n), np.concatenate([[0], np.cumsum(n)[:-1]]), ids, inverse))
        for r in range(rounds):
            step = rate * (1 - r / (rounds + 1))
            for k in rng.permutation(len(parts)).tolist():
                target, size, flat, owner, start, ids, inverse = parts[k]
                mean = np.add.reduceat(self.e[flat], start, axis=0) / size[:, None]
                z = mean @ self.w + self.b
                q = np.exp(z - z.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(len(q)), target] -= 1
                dm = ((q @ self.w.T) / size[:, None]).astype(np.float32)
                gw_, gb_ = mean.T @ q / 8, q.sum(0) / 8
                gw += gw_**2
                gb += gb_**2
                self.w -= step * gw_ / np.sqrt(gw)
                self.b -= step * gb_ / np.sqrt(gb)
                g = np.stack([np.bincount(inverse, dm[owner, j], len(ids)) for j in range(WIDTH)], 1).astype(np.float32)
                ge[ids] += (g**2).mean(1)
                self.e[ids] -= step * 0.3 * g / np.sqrt(ge[ids])[:, None]
        return self

    def table(self) -> tuple[np.ndarray, float]:
        """The log-odds that each bucket adds to the average, and the constant."""
        return np.where(self.seen, self.e @ (self.w[:, 1] - self.w[:, 0]), 0).astype(np.float32), float(self.b[1] - self.b[0])


class Scorer:
    """Scores of sentences from a model's table; what a word adds is kept."""

    def __init__(self, table: np.ndarray, constant: float):
        self.table, self.constant = table, constant
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sum, self.count, self.head = array("d"), array("q"), array("q")

    def _learn(self, tokens: set[str]) -> None:
        if len(self.known) > 400_000:
            self._forget()
        for t in tokens - self.known.keys():
            w = normal(t)
            g = grams(w) if w else []
            self.known[t] = len(self.sum)
            self.sum.append(float(self.table[g].sum()) if g else 0.0)
            self.count.append(len(g))
            self.head.append(g[0] if g else 0)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """The score of the worst window of each text; 0 for none."""
        tokens, lengths, owner = [], [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            for found in sentences(_joined(plain(text).lower())):
                tokens += found
                lengths.append(len(found))
                owner.append(k)
        out = np.zeros(len(texts))
        if not tokens:
            return out
        self._learn(set(tokens))
        at = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        sentence = np.repeat(np.arange(len(lengths)), lengths)
        counts = np.frombuffer(self.count, dtype=np.int64)[at]
        real = counts > 0
        at, sentence, counts = at[real], sentence[real], counts[real]
        sums, heads = np.frombuffer(self.sum)[at], np.frombuffer(self.head, dtype=np.int64)[at]
        # A pair of neighbours belongs to the second of them.
        inner = np.flatnonzero(sentence[1:] == sentence[:-1]) + 1
        pair = np.zeros((2, len(at)))
        pair[0, inner] = 3 * self.table[_pair(heads[inner - 1], heads[inner])]
        pair[1, inner] = 3
        words_ = np.stack([np.concatenate([[0.0], np.cumsum(x)]) for x in (sums, counts)])
        pairs_ = np.stack([np.concatenate([[0.0], np.cumsum(x)]) for x in pair])
        n = np.bincount(sentence, minlength=len(lengths))
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        windows = np.where(n > LONG, -(-(n - SPAN) // STRIDE) + 1, (n > 0).astype(np.int64))
        of = np.repeat(np.arange(len(n)), windows)
        number = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        long = n[of] > LONG
        start = first[of] + np.where(long, np.minimum(number * STRIDE, n[of] - SPAN), 0)
        end = np.where(long, start + SPAN, first[of] + n[of])
        total, size = (w[end] - w[start] + p[end] - p[np.minimum(start + 1, end)] for w, p in zip(words_, pairs_, strict=True))
        score = 1 / (1 + np.exp(-np.clip(total / (size + PRIOR) + self.constant, -30, 30)))
        np.maximum.at(out, np.array(owner)[of], score)
        return out


def train(labelled: list[tuple[list[str], int]], unlabelled: list[list[str]] = ()) -> tuple[np.ndarray, float]:
    """The table of a model from (texts of a message, label) and the texts of messages without one."""
    known: dict = {}
    flat, lexical, of, labels = [], [], [], []
    for texts, y in [*labelled, *((t, 0) for t in unlabelled)]:
        before = len(flat)
        for t in texts:
            for found in sentences(_joined(plain(t or "").lower())):
                w = [x for x in map(normal, found) if x]
                for i, j in windows(len(w)):
                    bag, lex = features(w[i:j], known)
                    flat.append(bag)
                    lexical.append(lex)
        if len(flat) > before:
            of += [len(labels)] * (len(flat) - before)
            labels.append(y)
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, dtype=np.float32), -30.0 if not len(y) or y.max() == 0 else 30.0
    of = np.array(of)
    first = np.searchsorted(of, np.arange(len(y) + 1))
    n = np.diff(first)
    sizes, every = np.array([len(f) for f in flat]), np.concatenate(flat)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    rng = np.random.default_rng(6)
    fold = rng.permutation(len(y)) % 2
    # The share of a window's words and pairs that other, harmless messages have too.
    lex_n = np.array([len(x) for x in lexical])
    lex = np.concatenate(lexical)
    own = np.unique(np.stack([np.repeat(of, lex_n), lex]), axis=1)
    spread = np.bincount(own[1][y[own[0]] == 0], minlength=BUCKETS)
    usual = np.add.reduceat((spread[lex] >= USUAL).astype(float), np.concatenate([[0], np.cumsum(lex_n)[:-1]])) / lex_n

    def odds(model: Model) -> np.ndarray:
        table, constant = model.table()
        return np.add.reduceat(table[every], start) / (sizes + PRIOR) + constant

    def fitted(members: np.ndarray, worst: np.ndarray | None, keep: np.ndarray, rounds: int) -> Model:
        """A model from the windows of ``members``: the worst of each message, and some more of harmless ones."""
        chosen, target = [], []
        for k in members[keep[members]].tolist():
            own = first[k] + (rng.permutation(n[k])[: OTHERS + 1] if n[k] > 1 else np.zeros(1, dtype=np.int64))
            if worst is not None:
                own = own[:0] if y[k] else own[:OTHERS][own[:OTHERS] != worst[k]]
                own = np.concatenate([[worst[k]], own])
            chosen += own.tolist()
            target += [y[k]] * len(own)
        return Model().fit([flat[i] for i in chosen], np.array(target, dtype=np.int64), rounds)

    everyone, keep, worst = np.arange(len(y)), np.ones(len(y), dtype=bool), None
    for _ in range(TURNS):
        held = np.zeros(len(flat))
        for f in (0, 1):
            found = odds(fitted(everyone[fold != f], worst, keep, ROUNDS // 2))
            held = np.where(fold[of] == f, found, held)
        # What is usual elsewhere is not what a message was labelled abusive for.
        order = np.lexsort((held - (y[of] == 1) * UNUSUAL * usual, of))
        worst = order[first[1:] - 1]
        keep = np.where(y == 1, (held[worst] > LEAST_ODDS) | (usual[worst] < 0.5), held[worst] < MOST_ODDS)
        if keep[y == 1].sum() < 5:
            keep[:] = True
    return fitted(everyone, worst, keep, ROUNDS).table()


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(*model.value)
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            text, caption = scorer(part.column(1).to_pylist()), scorer(part.column(2).to_pylist())
            field = np.where(np.maximum(text, caption) == 0, None, np.where(text >= caption, "text", "caption"))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(np.maximum(text, caption)), pa.array(field, pa.string())], names=["message_id", "chat_id", "score", "field"])


def scores(messages: DataFrame, labels: DataFrame, sample: int = SAMPLE, presumed: int = PRESUMED, threshold: float = THRESHOLD) -> DataFrame:
    """(message_id, chat_id, score, field, abusive) of every message."""
    spark = messages.sparkSession
    rows = messages.select(F.col("id").alias("message_id"), "text", "caption", "chat_id").where("message_id is not null")
    one = F.pmod(F.xxhash64("message_id"), F.lit(1 << 20))
    n, rest = labels.count(), messages.count()
    drawn = labels.where("message_id is not null and abusive is not null").where(one < int(min(1.0, sample / max(1, n)) * (1 << 20)))
    # Annotators who disagree: the greater part decides, a tie says nothing.
    voted = drawn.groupBy("message_id").agg(F.avg("abusive").alias("y")).where("y <> 0.5").select("message_id", (F.col("y") > 0.5).cast("int").alias("y"))
    # The draws bound what is broadcast and collected: about ``sample`` votes and ``presumed`` messages, whatever the tables.
    taken = F.col("y").isNotNull() | (F.pmod(F.xxhash64("message_id", F.lit("presumed")), F.lit(1 << 20)) < int(min(1.0, presumed / max(1, rest)) * (1 << 20)))
    picked = rows.join(F.broadcast(voted), "message_id", "left").where(taken).select("message_id", "text", "caption", "y").orderBy("message_id", "text", "caption").collect()
    texts = {r["message_id"]: ([t for t in (r["text"], r["caption"]) if t], r["y"]) for r in picked}
    model = spark.sparkContext.broadcast(train([(t, y) for t, y in texts.values() if y is not None], [t for t, y in texts.values() if y is None]))
    kinds = dict(rows.dtypes)
    scored = rows.mapInArrow(partial(_scored, model=model), f"message_id {kinds['message_id']}, chat_id {kinds['chat_id']}, score double, field string")
    return scored.withColumn("abusive", F.col("score") >= threshold)


def found(scored: DataFrame) -> DataFrame:
    """(message_id) of every message that passes the threshold."""
    return scored.where("abusive").select("message_id").distinct()


def rates(scored: DataFrame) -> DataFrame:
    """(chat_id, messages, abusive, rate) of every chat; messages without one are a chat of their own (null)."""
    one = scored.groupBy("message_id").agg(F.max("chat_id").alias("chat_id"), F.max("abusive").alias("abusive"))
    return one.groupBy("chat_id").agg(F.count("*").alias("messages"), F.count_if("abusive").alias("abusive")).withColumn("rate", F.col("abusive") / F.col("messages"))
