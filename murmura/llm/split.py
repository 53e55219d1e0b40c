"""Splitting oversized texts at natural boundaries.

The words' lengths are summed to offsets; the starts of paragraphs, lines, sentences and words are sorted arrays of
such offsets. A piece ends at the last boundary of the strongest kind under the limit that lies in its second half
(binary search), and its successor begins at the word start nearest to ``overlap`` characters before that end. Where
no boundary lies in the second half, the text is cut at the limit (never before a combining mark or a joiner).

Results: texts of at most ``limit`` code points (null, empty and blank ones too) have no piece; a longer one has pieces
0..n-1 that together cover it from 0 to its end, each of 1..limit code points, in order.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 100
#: A word starts where white space ends; what stands before tells its kind.
_WORD = re.compile(r"\S+")
_ENDS = ".!?…。！？;:»”\"')]"
PIECES = "message_id string, source_field string, piece_no int, start int, end int, piece string"
_ARROW = pa.schema([("message_id", pa.string()), ("source_field", pa.string()), ("piece_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("piece", pa.string())])


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted word starts of each kind, the strongest first: paragraphs, lines, sentences, words."""
    spans = np.array([m.span() for m in _WORD.finditer(text)], dtype=np.int64).reshape(-1, 2)
    starts, gap_from = spans[1:, 0], spans[:-1, 1]
    breaks = np.cumsum(np.fromiter((c in "\n\x0b\x0c\r\x85  " and not (c == "\n" and i and text[i - 1] == "\r") for i, c in enumerate(text)), dtype=np.int64, count=len(text)))
    lines = breaks[starts - 1] - breaks[gap_from - 1] if len(starts) else np.empty(0, dtype=np.int64)
    ended = np.fromiter((text[i - 1] in _ENDS for i in gap_from.tolist()), dtype=bool, count=len(starts))
    return [starts[lines >= 2], starts[lines >= 1], starts[ended], starts]


def _hard(text: str, at: int, least: int) -> int:
    """A cut at ``at``, or a little before, that parts no joined signs."""
    back = at
    while back > least and (unicodedata.combining(text[back]) or text[back] in "‍️︎" or text[back - 1] == "‍" or "\U0001f3fb" <= text[back] <= "\U0001f3ff"):
        back -= 1
    return back if back > least else at


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text longer than ``limit``."""
    if not 0 <= overlap * 4 <= limit:
        raise ValueError("the overlap may be a quarter of the limit at most")
    n, start, out = len(text), 0, []
    kinds = boundaries(text)
    words = kinds[-1]
    while n - start > limit:
        most, least = start + limit, start + limit // 2
        for kind in kinds:
            k = int(np.searchsorted(kind, most, side="right")) - 1
            if k >= 0 and kind[k] > least:
                end = int(kind[k])
                break
        else:
            end = _hard(text, most, least)
        out.append((start, end))
        target = end - overlap
        k = int(np.searchsorted(words, target))
        near = [int(w) for w in words[max(0, k - 1) : k + 1] if abs(int(w) - target) <= overlap // 2 and start < w < end]
        start = min(near, key=lambda w: abs(w - target)) if near else _hard(text, target, start + 1)
    out.append((start, n))
    return out


def _batches(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, field, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            rows += [(i, field, k, a, b, text[a:b]) for k, (a, b) in enumerate(spans(text, limit, overlap))]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def long_items(messages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(message_id, source_field, item) of texts and transcriptions over the limit; a message counts once."""
    fields = F.array(
        F.struct(F.lit("text").alias("source_field"), F.col("text").alias("item")),
        F.struct(F.lit("attachment.transcription").alias("source_field"), F.col("attachment.transcription").alias("item")),
    )
    return (
        messages.where((F.length("text") > limit) | (F.length("attachment.transcription") > limit))
        .select(F.col("id").alias("message_id"), F.inline(fields))
        .where(F.length("item") > limit)
        .dropDuplicates(["message_id", "source_field"])
    )


def pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Rows of PIECES of (message_id, source_field, item)."""
    return items.where(F.length("item") > limit).select("message_id", "source_field", "item").mapInArrow(partial(_batches, limit=limit, overlap=overlap), PIECES)
