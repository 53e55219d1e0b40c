"""Models as batch functions: a registry of providers, and deterministic stand-ins.

No weights come with this repository. The stand-ins are no semantic models: the classifier draws a probability from a
hash of the text, the encoders hash tokens. Real providers are registered under a name and are built once for each
Python worker, from a local folder, else - where allowed - by their own download, else not at all.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: kind -> name -> builder(folder or None) of a function on a list of inputs.
_PROVIDERS: dict[str, dict[str, Callable]] = {"classifier": {}, "text": {}, "image": {}, "speech": {}}


def register(kind: str, name: str, build: Callable) -> None:
    _PROVIDERS[kind][name] = build


def resolve(name: str, folder: str | None = None, download_allowed: bool = True, load: bool = True, kind: str = "text"):
    """A model: from its folder if that exists, else by download if allowed; ``load=False`` only says which."""
    if name not in _PROVIDERS[kind]:
        raise KeyError(f"no {kind} model is registered as {name}")
    local = os.path.join(folder, name.replace("/", "_")) if folder else None
    if local and os.path.isdir(local):
        source: str | None = local
    elif download_allowed:
        source = None
    else:
        raise RuntimeError(f"{name} is not in {folder} and must not be downloaded")
    return _PROVIDERS[kind][name](source) if load else source


@lru_cache(maxsize=8)
def _loaded(kind: str, name: str, folder: str | None, download_allowed: bool):
    return resolve(name, folder, download_allowed, kind=kind)


def probability(text: str) -> float:
    return int(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) / 2**32


def _standin_classifier(_folder: str | None) -> Callable[[Sequence[str]], list[dict]]:
    def run(texts: Sequence[str]) -> list[dict]:
        p = [probability(t) for t in texts]
        return [{"label": "LABEL_1" if x >= 0.5 else "LABEL_0", "score": max(x, 1 - x)} for x in p]

    return run


def hashed_vector(text: str, dim: int) -> np.ndarray:
    """Tokens hashed to signed places, over their norm; a text without tokens has the first unit vector."""
    v = np.zeros(dim)
    for token in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()[:8], "big")
        v[h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    if not n:
        v[0], n = 1, 1
    return (v / n).astype(np.float32)


register("classifier", "standin", _standin_classifier)
register("text", "standin", lambda _f: lambda texts: [hashed_vector(t, 384) for t in texts])
#: The text side of the image stand-in: captions and query texts share its places.
register("text", "standin-joint", lambda _f: lambda texts: [hashed_vector(t, 512) for t in texts])
register("image", "standin", lambda _f: lambda pairs: [hashed_vector(hashlib.md5(content or b"").hexdigest() + " " + caption, 512) for content, caption in pairs])
register("speech", "standin", lambda _f: lambda blobs: [([" text ", "of ", str(len(b)), " bytes"], "de", 0.5) if b.strip(b"\0") else ([], "de", 0.0) for b in blobs])


def checked_labels(found: list, n: int) -> list[dict]:
    """Results of a classifier: as many as texts, each with label and score."""
    if len(found) != n or not all(isinstance(r, dict) and {"label", "score"} <= r.keys() for r in found):
        raise ValueError("the classifier's results do not match the texts")
    return found


def classify_column(text: Column, name: str = "standin", folder: str | None = None, download_allowed: bool = True, batch: int = 265) -> Column:
    """struct<label, score> of a text; null texts are not shown to the model and have null parts."""

    @F.pandas_udf("label string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _loaded("classifier", name, folder, download_allowed)
        for texts in batches:
            there = texts[texts.notna()]
            found: list[dict] = []
            for a in range(0, len(there), batch):
                part = there.iloc[a : a + batch].tolist()
                found += checked_labels(model(part), len(part))
            out = pd.DataFrame({"label": None, "score": np.nan}, index=texts.index).astype({"label": object})
            out.loc[there.index, "label"] = [r["label"] for r in found]
            out.loc[there.index, "score"] = [float(r["score"]) for r in found]
            yield out

    return run(text)


def encode_column(text: Column, name: str = "standin", folder: str | None = None, download_allowed: bool = True, batch: int = 32) -> Column:
    """Vector of a text."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded("text", name, folder, download_allowed)
        for texts in batches:
            out: list = []
            for a in range(0, len(texts), batch):
                part = texts.iloc[a : a + batch].tolist()
                vectors = model(part)
                if len(vectors) != len(part):
                    raise ValueError("the encoder's vectors do not match the texts")
                out += [np.asarray(v, dtype=np.float32) for v in vectors]
            yield pd.Series(out)

    return run(text)


def encode_query(text: str, name: str = "standin", normalized: bool = False) -> list[float]:
    """Vector of a query text, over its norm if asked for; empty if the model gives nothing usable."""
    v = _loaded("text", name, None, True)([text])[0]
    v = np.asarray(v, dtype=float)
    if v.ndim != 1:
        return []
    return (v / np.linalg.norm(v) if normalized and np.linalg.norm(v) else v).tolist()


def positive_score(label: Column, score: Column) -> Column:
    """The score of the positive class."""
    return F.when(label == "LABEL_1", score).otherwise(F.lit(1.0) - score)


def tally(results: DataFrame, score: str = "score_pos") -> DataFrame:
    """(positive, negative): scores over one half, and the others."""
    return results.agg(F.count_if(F.col(score) > 0.5).alias("positive"), F.count_if(F.col(score) <= 0.5).alias("negative"))
