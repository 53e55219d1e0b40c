"""Sentences of chat texts, and what in them is no language."""

from __future__ import annotations

import re

#: A sentence ends at a line break, or at closing marks or a pictogram before white space.
_END = re.compile(r"(?<=[.!?…\U0001f300-\U0001faff])[\"'»”)\]]*\s+|(?<!\s)\s*[\n\r\x0b\x0c\x85  ]+\s*")
#: Links, addresses, handles and hashtags.
_ADDRESS = re.compile(r"(?<![\w.+-])[\w.+-]++ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]+)+")
_OTHER = re.compile(r"(?:[hH][tT][tT][pP][sS]?://|ftp://|www\.|t\.me/)\S+|[@#]\w+")


def _blank(m: re.Match) -> str:
    return " " * len(m[0])


def plain(text: str) -> str:
    """The text with spaces in place of links, addresses, handles and hashtags; places stay the same."""
    if "@" in text or "(at)" in text or "[at]" in text:
        text = _ADDRESS.sub(_blank, text)
    return _OTHER.sub(_blank, text)


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in order, without the white space between them."""
    out, at = [], 0
    for m in _END.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out
