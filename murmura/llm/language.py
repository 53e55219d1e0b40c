"""Languages of texts and of the stretches of mixed ones, by a byte convolutional network.

Every sentence, without links, addresses, handles and hashtags, is laid out as windows of at most WINDOW bytes of
equal length. Filters of several widths run over the embedded bytes of a window; the greatest response of each goes to
a softmax over the languages. The network is trained with numpy on messages with a label in a usual spelling: at most
``SAMPLE`` messages of each language, picked by a hash of the id. After half of the rounds, sentences whose label
the network finds unlikely are left out, since labels err. The windows of a text are then read as a sequence in which
changing the language costs little between sentences and much within one (Viterbi).

Results of ``label``: one row for each message id with a text - the stretches (start, end, language, confidence,
letters), the language of most letters with its confidence, and whether the label is confirmed, filled in or corrected
(``unknown`` where the text has no letters). Null texts have no row; repeated rows of a message count once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.llm.sentences import plain, spans

LANGUAGES = ("de", "en", "es", "fr", "nl", "ru")
#: Three-letter codes and names that stand for a two-letter code.
SPELLINGS = {
    "deu": "de", "ger": "de", "eng": "en", "spa": "es", "esl": "es", "fra": "fr", "fre": "fr", "nld": "nl", "dut": "nl", "rus": "ru",
    "ita": "it", "por": "pt", "dan": "da", "ltz": "lb", "afr": "af", "bul": "bg", "ukr": "uk", "pol": "pl", "swe": "sv", "nor": "no", "tur": "tr",
}
#: Labels that state no language.
PLACEHOLDERS = ("xx", "und", "unk", "mul", "zxx", "mis", "qaa", "na", "none", "null", "unknown")
SAMPLE, WINDOW = 400, 96
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4, 5), 16, 8
ROUNDS = 6
LEAST_LETTERS = 30
#: Of a labelled message, so many windows spread over the whole of it are fitted to at most, so that none outweighs the others.
WINDOWS_EACH = 64
SWITCH_BETWEEN, SWITCH_WITHIN = 2.5, 6.0


def stated(label: Column) -> Column:
    """The two-letter code that a label states in any usual spelling; null for none."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,8})(?:[-_.].*)?$", 1)
    known = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    code = F.coalesce(known[head], head)
    return F.when((F.length(code) == 2) & ~code.isin(*PLACEHOLDERS), code)


class Network:
    """Embedding, filters of several widths, greatest response, softmax."""

    def __init__(self, classes: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.widest = max(WIDTHS)
        f = FILTERS * len(WIDTHS)
        self.e = (rng.standard_normal((256, EMBEDDED)) * 0.5).astype(np.float32)
        self.e[0] = 0
        self.w = (rng.standard_normal((self.widest * EMBEDDED, f)) * 0.15).astype(np.float32)
        # A narrow filter is a wide one whose last columns stay zero.
        self.mask = np.zeros_like(self.w)
        for i, width in enumerate(WIDTHS):
            self.mask[: width * EMBEDDED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.w *= self.mask
        self.b = np.zeros(f, dtype=np.float32)
        self.v = (rng.standard_normal((f, classes)) * 0.1).astype(np.float32)
        self.c = np.zeros(classes, dtype=np.float32)

    def _patches(self, x: np.ndarray) -> np.ndarray:
        flat = self.e[x].reshape(len(x), -1)
        return np.ascontiguousarray(sliding_window_view(flat, self.widest * EMBEDDED, axis=1)[:, ::EMBEDDED])

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.c)), dtype=np.float32)
        for a in range(0, len(x), 256):
            p = self._patches(x[a : a + 256])
            h = np.maximum((p.reshape(-1, p.shape[2]) @ self.w).reshape(len(p), -1, self.w.shape[1]).max(1) + self.b, 0)
            z = h @ self.v + self.c
            z -= z.max(1, keepdims=True)
            out[a : a + 256] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.004, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        params = ["e", "w", "b", "v", "c"]
        m = {k: np.zeros_like(getattr(self, k)) for k in params}
        s = {k: np.zeros_like(getattr(self, k)) for k in params}
        step, keep = 0, np.arange(len(x))
        weight = np.bincount(y, minlength=len(self.c)).astype(float)
        weight = np.where(weight > 0, weight.sum() / np.maximum(weight, 1) / max(1, (weight > 0).sum()), 0)
        for r in range(rounds):
            if r == rounds // 2 and len(x) > 200:
                keep = np.flatnonzero(self.log_probabilities(x)[np.arange(len(y)), y] > np.log(0.3))
            if not len(keep):
                return
            order = rng.permutation(keep)
            for a in range(0, len(order), 128):
                at = order[a : a + 128]
                xb, yb = x[at], y[at]
                p = self._patches(xb)
                n, positions, k = p.shape
                full = (p.reshape(-1, k) @ self.w).reshape(n, positions, -1)
                arg = full.argmax(1)
                pre = np.take_along_axis(full, arg[:, None, :], 1)[:, 0] + self.b
                h = np.maximum(pre, 0)
                z = h @ self.v + self.c
                q = np.exp(z - z.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(n), yb] -= 1
                dz = (q * weight[yb][:, None] / n).astype(np.float32)
                dh = (dz @ self.v.T) * (pre > 0)
                best = np.take_along_axis(p, arg[:, :, None], 1)  # n, filters, k
                dp = dh[:, :, None] * self.w.T[None]
                bytes_at = xb[np.arange(n)[:, None, None], arg[:, :, None] + np.arange(self.widest)]
                flat = bytes_at.ravel()
                de = np.stack([np.bincount(flat, dp.reshape(n, -1, self.widest, EMBEDDED)[..., j].ravel(), 256) for j in range(EMBEDDED)], 1)
                de[0] = 0
                grads = {"e": de, "w": np.einsum("nf,nfk->kf", dh, best) * self.mask, "b": dh.sum(0), "v": h.T @ dz, "c": dz.sum(0)}
                step += 1
                for k2, g in grads.items():
                    m[k2] = 0.9 * m[k2] + 0.1 * g
                    s[k2] = 0.99 * s[k2] + 0.01 * g * g
                    change = rate * (m[k2] / (1 - 0.9**step)) / (np.sqrt(s[k2] / (1 - 0.99**step)) + 1e-7)
                    setattr(self, k2, (getattr(self, k2) - change).astype(np.float32))


def lay_out(texts: list[str]) -> tuple[np.ndarray, list[tuple[int, int, int, bool]]]:
    """Windows of bytes, and for each (text number, start, end in the text, whether it begins a sentence)."""
    rows, places = [], []
    for k, text in enumerate(texts):
        bare = plain(text)
        for a, b in spans(bare):
            sentence = bare[a:b].lower()
            raw = sentence.encode("utf-8", "replace")
            n = -(-len(raw) // WINDOW)
            if n == 1:
                rows.append(raw)
                places.append((k, a, b, True))
                continue
            # Equal parts, cut between characters: in characters, as lower-casing may change lengths the end is bounded.
            chars = len(sentence)
            while True:
                parts = [sentence[i * chars // n : (i + 1) * chars // n].encode("utf-8", "replace") for i in range(n)]
                longest = max(map(len, parts))
                if longest <= WINDOW:
                    break
                n = max(n + 1, n * longest // WINDOW)
            for i in range(n):
                lo, hi = i * chars // n, (i + 1) * chars // n
                rows.append(parts[i])
                places.append((k, min(b, a + lo), b if i == n - 1 else min(b, a + hi), i == 0))
    x = np.zeros((len(rows), WINDOW), dtype=np.uint8)
    if rows:
        lengths = np.array([len(r) for r in rows])
        x[np.arange(WINDOW)[None, :] < lengths[:, None]] = np.frombuffer(b"".join(rows), dtype=np.uint8)
    # Digits say nothing of the language.
    x[(x >= 48) & (x <= 57)] = 48
    return x, places


def letters(x: np.ndarray) -> np.ndarray:
    """Letters of each window: basic ones, and those of two and three bytes by their first (not the blocks of signs from U+2000 and U+3000)."""
    long = (x >= 0xE0) & (x <= 0xEF) & (x != 0xE2)
    long[:, :-1] &= (x[:, :-1] != 0xE3) | (x[:, 1:] != 0x80)
    return (((x >= 97) & (x <= 122)) | ((x >= 0xC3) & (x <= 0xDF)) | long).sum(1)


def best_paths(scores: np.ndarray, owner: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The best sequence of languages for each text; all texts advance window by window together."""
    n, c = scores.shape
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if n else np.empty(0, dtype=np.int64)
    length = np.diff(np.concatenate([first, [n]]))
    back = np.zeros((n, c), dtype=np.int8)
    total = scores.copy()
    for t in range(1, int(length.max(initial=0))):
        at = first[length > t] + t
        cost = np.where(begins[at], SWITCH_BETWEEN, SWITCH_WITHIN)
        before = total[at - 1]
        switch = before.max(1) - cost
        stay = before >= switch[:, None]
        back[at] = np.where(stay, np.arange(c)[None, :], before.argmax(1)[:, None])
        total[at] += np.where(stay, before, switch[:, None])
    path = np.zeros(n, dtype=np.int64)
    last = first + length - 1
    path[last] = total[last].argmax(1)
    for t in range(int(length.max(initial=0)) - 1, 0, -1):
        at = first[length > t] + t
        path[at - 1] = back[at, path[at]]
    return path


def without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def train(labelled: list[tuple[str, str]], languages=LANGUAGES) -> Network:
    """A network from (language, text)."""
    number = {lang: i for i, lang in enumerate(languages)}
    labelled = [(lang, t) for lang, t in labelled if lang in number and t]
    labelled += [(lang, without_accents(t)) for lang, t in labelled[::3]]
    x, places = lay_out([t for _, t in labelled])
    net = Network(len(languages))
    if len(x):
        y = np.array([number[labelled[p[0]][0]] for p in places])
        enough = letters(x) >= 12
        first = np.searchsorted(owner := np.array([p[0] for p in places]), owner)
        n, k = np.bincount(owner)[owner], np.arange(len(owner)) - first
        enough &= (k * WINDOWS_EACH // n != (k - 1) * WINDOWS_EACH // n) | (n <= WINDOWS_EACH)
        if enough.any():
            net.fit(x[enough], y[enough])
    return net


SEGMENTS = "array<struct<start:int,end:int,lang:string,confidence:double,letters:int>>"
_SEGMENTS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("letters", pa.int32())]))


def stretches(net: Network, texts: list[str], languages=LANGUAGES) -> list[list[dict]]:
    """The stretches of each text, in order: neighbouring windows of one language."""
    x, places = lay_out(texts)
    out: list[list[dict]] = [[] for _ in texts]
    if not len(x):
        return out
    count = letters(x)
    logs = net.log_probabilities(x)
    # Windows of few letters weigh little.
    scores = np.maximum(logs, -6.0) * np.minimum(1.0, count / 20.0)[:, None]
    owner = np.array([p[0] for p in places])
    path = best_paths(scores, owner, np.array([p[3] for p in places]))
    sure = np.exp(logs[np.arange(len(x)), path]) * count
    for i, (k, a, b, _) in enumerate(places):
        lang = languages[path[i]]
        if out[k] and out[k][-1]["lang"] == lang:
            s = out[k][-1]
            s["end"], s["letters"], s["confidence"] = b, s["letters"] + int(count[i]), s["confidence"] + float(sure[i])
        else:
            out[k].append({"start": a, "end": b, "lang": lang, "confidence": float(sure[i]), "letters": int(count[i])})
    for found in out:
        for s in found:
            s["confidence"] = s["confidence"] / s["letters"] if s["letters"] else 0.0
    return [[s for s in found if s["letters"]] for found in out]


def _labelled(batches: Iterator[pa.RecordBatch], net, languages) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            found = stretches(net.value, part.column("text").to_pylist(), languages)
            yield pa.RecordBatch.from_arrays([part.column("message_id"), part.column("label"), pa.array(found, _SEGMENTS)], names=["message_id", "label", "segments"])


def segments(messages: DataFrame, languages=LANGUAGES, sample: int = SAMPLE, key: str = "id", text: str = "text", label: str = "language") -> DataFrame:
    """(message_id, label, segments): the two-letter code that the label states, and the stretches of the text."""
    spark = messages.sparkSession
    rows = messages.select(F.col(key).alias("message_id"), stated(F.col(label)).alias("label"), F.col(text).alias("text")).where("text is not null and message_id is not null")
    counts = {r["label"]: r["count"] for r in rows.where(F.col("label").isin(*languages)).groupBy("label").count().collect()}
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("label") == lang, F.lit(int(min(1.0, sample / n) * (1 << 20)))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("message_id"), F.lit(1 << 20)) < share).select("label", "text", "message_id")
    net = train([(r["label"], r["text"]) for r in drawn.orderBy("message_id", "text").collect()], languages)
    shared = spark.sparkContext.broadcast(net)
    kind = dict(rows.dtypes)["message_id"]
    return rows.mapInArrow(partial(_labelled, net=shared, languages=languages), f"message_id {kind}, label string, segments {SEGMENTS}")


def found(labelled: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """(message_id, lang) of every language with ``least`` letters that the label does not state."""

    def of(lang: Column) -> Column:
        return F.aggregate("segments", F.lit(0), lambda total, s: total + F.when(s["lang"] == lang, s["letters"]).otherwise(0))

    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    missing = F.filter(langs, lambda lang: (of(lang) >= least) & (F.col("label").isNull() | (lang != F.col("label"))))
    return labelled.select("message_id", F.explode(missing).alias("lang")).distinct()


def label(labelled: DataFrame) -> DataFrame:
    """(message_id, stated, lang, confidence, verdict, segments): one row for each message."""
    by = F.array_sort("segments", lambda a, b: F.when(a["letters"] > b["letters"], -1).when(a["letters"] < b["letters"], 1).otherwise(0))
    main = F.try_element_at(by, F.lit(1))
    verdict = (
        F.when(F.col("lang").isNull(), "unknown").when(F.col("stated").isNull(), "filled in").when(F.exists("segments", lambda s: s["lang"] == F.col("stated")), "confirmed").otherwise("corrected")
    )
    rows = labelled.dropDuplicates(["message_id"]).select("message_id", F.col("label").alias("stated"), main["lang"].alias("lang"), main["confidence"].alias("confidence"), "segments")
    return rows.withColumn("verdict", verdict)
