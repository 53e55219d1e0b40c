"""Public tokenizers from vocabulary files; their folder is a parameter (or MURMURA_TOKENIZERS)."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import tiktoken

FOLDER = os.environ.get("MURMURA_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pattern that splits text before the merges of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = FOLDER) -> tiktoken.Encoding:
    """The byte-level encoding of a rank file; one for each Python worker. It has no special tokens."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
