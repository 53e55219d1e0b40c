"""Encoding of whole texts by a public tokenizer, in overlapping chunks.

A text is laid out as windows of ``CHUNK`` characters, each reaching ``OVERLAP`` characters into the next. Windows are
pre-tokenised on their own, all windows of a batch at once: characters become classes, and the pattern's boundaries
follow from where classes change. Where a window and its successor first have a pre-token boundary in common, both
continue alike (the pattern looks ahead only), so the text is cut there, and the pieces are encoded. From a pair of
windows that share no boundary (a run of one kind of sign longer than the overlap) the rest of the text is one piece.

Texts longer than ``SPREAD`` are cut into windows of that length over the whole cluster first: every such window is
worked as above in a task of its own, and the ids are joined where neighbouring windows have a boundary in common.

Results: one row for each row with a key; a null and an empty text have the empty list; names of special tokens are
ordinary text; repeated keys keep their rows. Decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.vocab import FOLDER, encoding

CHUNK, OVERLAP, SPREAD = 512, 64, 1 << 16
IDS = "doc_id bigint, ids array<int>"
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_SIZES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
WINDOWS = "row bigint, doc_id bigint, k int, last boolean, window string"
_WINDOWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("last", pa.bool_()), ("window", pa.string())])
PARTS = "row bigint, doc_id bigint, k int, window string, ids array<int>, cut int, head array<int>, before array<int>"
_PARTS = pa.schema([*list(_WINDOWS)[:3], ("window", pa.string()), ("ids", pa.list_(pa.int32())), ("cut", pa.int32()), ("head", pa.list_(pa.int32())), ("before", pa.list_(pa.int32()))])
#: Classes of characters.
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point; a blank is the space that a pre-token may begin with."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[32] = BLANK
    return out


def boundaries(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(whether a pre-token begins at each character of the windows laid end to end, where each window begins)."""
    lengths = np.fromiter(map(len, windows), dtype=np.int64, count=len(windows))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    signs = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(signs)
    if not n:
        return np.zeros(0, dtype=bool), starts
    first = np.zeros(n + 1, dtype=bool)
    first[starts] = True
    first = first[:n]
    kind = classes()[signs]
    white = kind >= SPACE
    group = np.where(white, SPACE, kind)
    run = first.copy()
    run[1:] |= group[1:] != group[:-1]
    ends = np.concatenate([run[1:], [True]])
    last = np.concatenate([first[1:], [True]])
    begins = run.copy()
    # The last sign of white space before others begins anew; a blank takes what follows with it.
    inner = white & ends & ~last
    begins[inner] = True
    after = np.flatnonzero(inner & (kind == BLANK)) + 1
    begins[after] = False
    # Contractions: an apostrophe that a pre-token begins with, and small letters after it.
    at = np.flatnonzero((signs == 39) & begins)
    if len(at):
        end = starts[np.searchsorted(starts, at, side="right")]

        def sign(offset: int, letter: str) -> np.ndarray:
            return (at + offset < end) & (signs[np.minimum(at + offset, n - 1)] == ord(letter))

        one = sign(1, "s") | sign(1, "t") | sign(1, "m") | sign(1, "d")
        two = (sign(1, "r") & sign(2, "e")) | (sign(1, "v") & sign(2, "e")) | (sign(1, "l") & sign(2, "l"))
        for found, size in ((at[one], 1), (at[two], 2)):
            begins[found + 1] = False
            follows = found + size + 1
            follows = follows[follows < n]
            begins[follows] = True
    return begins, starts


def windows(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Windows of a text: the k-th begins at k * chunk and reaches ``overlap`` into the next."""
    return [text[a : a + chunk + overlap] for a in range(0, max(1, len(text)), chunk)]


def cuts(laid: list[str], pairs: np.ndarray, chunk: int, overlap: int) -> np.ndarray:
    """For each window of ``pairs``, which its successor follows: the first boundary of both, within the successor; -1 for none."""
    begins, starts = boundaries(laid)
    if not len(pairs):
        return np.empty(0, dtype=np.int64)
    step = np.arange(overlap)
    # The last sign of a window may belong to a longer pre-token; boundaries before it are sure.
    sure = step[None, :] < (np.diff(starts)[pairs] - chunk - 1)[:, None]
    mine, theirs = starts[pairs, None] + chunk + step, starts[pairs + 1, None] + step
    common = sure & begins[np.minimum(mine, len(begins) - 1)] & begins[np.minimum(theirs, len(begins) - 1)]
    return np.where(common.any(1), common.argmax(1), -1)


def pieces(texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[list[str]]:
    """The pieces of each text, cut at common boundaries of neighbouring windows."""
    laid, owner = [], []
    for i, t in enumerate(texts):
        w = windows(t, chunk, overlap)
        laid += w
        owner += [i] * len(w)
    of = np.array(owner, dtype=np.int64)
    pairs = np.flatnonzero(of[1:] == of[:-1])
    cut = cuts(laid, pairs, chunk, overlap)
    first = np.searchsorted(of, np.arange(len(texts)))
    out: list[list[str]] = [[] for _ in texts]
    at = [0] * len(texts)
    broken = set()
    for p, c in zip(pairs.tolist(), cut.tolist(), strict=True):
        i = owner[p]
        if i in broken:
            continue
        if c < 0:
            broken.add(i)
            continue
        end = (p + 1 - int(first[i])) * chunk + c
        out[i].append(texts[i][at[i] : end])
        at[i] = end
    for i, t in enumerate(texts):
        out[i].append(t[at[i] :])
    return out


def ids_of(enc, texts: list[str | None], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[list[int]]:
    """The ids of each text, piece by piece."""
    return [[x for piece in found for x in enc.encode_ordinary(piece)] for found in pieces([t or "" for t in texts], chunk, overlap)]


def part(enc, window: str, last: bool, spread: int = SPREAD, overlap: int = OVERLAP, chunk: int = CHUNK) -> tuple[list[int], int | None, list[int], list[int]]:
    """(ids up to the cut, cut within the next window or None, boundaries in the head of the window, ids before each).

    ``cut`` is -1 in the last window, None where no boundary is shared.
    """
    cut = -1
    if not last:
        c = int(cuts([window, window[spread:]], np.array([0]), spread, overlap)[0])
        cut = None if c < 0 else c
    stop = len(window) if cut is None or last else spread + cut
    heads = np.flatnonzero(boundaries([window[: 2 * overlap]])[0][: min(overlap, stop) + 1]).tolist() or [0]
    ids: list[int] = []
    before = []
    for a, b in zip(heads, heads[1:], strict=False):
        before.append(len(ids))
        ids += enc.encode_ordinary(window[a:b])
    before.append(len(ids))
    ids += ids_of(enc, [window[heads[-1] : stop]], chunk, overlap)[0]
    return ids, cut, heads, before


def stitch(parts: list[dict], enc=None, spread: int = SPREAD) -> list[int] | None:
    """Ids of a text from its windows' parts in order; where one found no cut the rest is encoded as a whole."""
    out: list[int] = []
    at = 0
    for k, p in enumerate(parts):
        if p["cut"] is None or at not in p["head"]:
            return out + enc.encode_ordinary("".join(q["window"][:spread] for q in parts[k:])[at:]) if enc else None
        out += p["ids"][p["before"][p["head"].index(at)] :]
        at = p["cut"]
    return out


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _local(batches: Iterator[pa.RecordBatch], name: str, folder: str, chunk: int, overlap: int, count: bool) -> Iterator[pa.RecordBatch]:
    enc = encoding(name, folder)
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            b = batch.slice(k, 500)
            ids = ids_of(enc, b.column(1).to_pylist(), chunk, overlap)
            yield _batch([b.column(0), list(map(len, ids))], _SIZES) if count else _batch([b.column(0), ids], _IDS)


def _lay_out(batches: Iterator[pa.RecordBatch], spread: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, i, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            w = windows(text, spread, overlap)
            yield _batch([[row] * len(w), [i] * len(w), range(len(w)), [False] * (len(w) - 1) + [True], w], _WINDOWS)


def _parts(batches: Iterator[pa.RecordBatch], name: str, folder: str, spread: int, overlap: int, chunk: int) -> Iterator[pa.RecordBatch]:
    enc = encoding(name, folder)
    for batch in batches:
        rows = [part(enc, w, last, spread, overlap, chunk) for w, last in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield _batch([*(batch.column(c) for c in (0, 1, 2, 4)), *(list(c) for c in zip(*rows, strict=True))] if rows else [[] for _ in _PARTS], _PARTS)


def _stitched(batches: Iterator[pa.RecordBatch], name: str, folder: str, spread: int, count: bool) -> Iterator[pa.RecordBatch]:
    enc = encoding(name, folder)
    for batch in batches:
        ids = [stitch(p, enc, spread) for p in batch.column(1).to_pylist()]
        yield _batch([batch.column(0), list(map(len, ids))], _SIZES) if count else _batch([batch.column(0), ids], _IDS)


def _encoded(documents: DataFrame, key: str, text: str, name: str, folder: str, chunk: int, overlap: int, spread: int, count: bool) -> DataFrame:
    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id bigint, n_tokens bigint" if count else IDS
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= spread).mapInArrow(partial(_local, name=name, folder=folder, chunk=chunk, overlap=overlap, count=count), schema)
    # Windows of one text go to many tasks: a collection whose bulk is one text still spreads. A row's number keeps rows of one key apart.
    long = rows.where(F.length("text") > spread).select(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("row"), "doc_id", "text")
    laid = long.mapInArrow(partial(_lay_out, spread=spread, overlap=overlap), WINDOWS).repartition("row", "k")
    parts = laid.mapInArrow(partial(_parts, name=name, folder=folder, spread=spread, overlap=overlap, chunk=chunk), PARTS)
    joined = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "window", "ids", "cut", "head", "before"))).alias("parts"))
    return short.unionByName(joined.select("doc_id", "parts").mapInArrow(partial(_stitched, name=name, folder=folder, spread=spread, count=count), schema))


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """(doc_id, ids) of every text."""
    return _encoded(documents, key, text, name, folder, chunk, overlap, spread, False)


def sizes(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """(doc_id, n_tokens) of every text, by the same windows; 0 for null and empty ones."""
    return _encoded(documents, key, text, name, folder, chunk, overlap, spread, True)


def decode(ids: list[int], name: str = "byte_bpe_50k", folder: str = FOLDER) -> str:
    """The text of ids: their raw bytes, joined."""
    enc = encoding(name, folder)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8")
