"""Very long texts of one kind of sign must not cost more than in proportion."""

import time

import numpy as np
import pytest

from murmura.llm import encode, language, moderation, near, personal, reading, sentences, split

N = 60_000
TEXTS = {
    "dashes": "-" * N + " a@b.example", "dots": "." * N + "@", "digits": "1234567890" * (N // 10), "letters": "ab" * (N // 2), "spaced": "a b " * (N // 4), "ats": "a@" * (N // 2),
    "spaces": " " * N + "x", "lines": "\n" * N, "mixed": "a1" * (N // 2), "plus": "+1 " * (N // 3), "emoji": "😀" * N, "words": "Straße 1 " * (N // 9), "names": "Felix " * (N // 6), "commas": "Emma, " * (N // 6), "parens": "((((1" * (N // 5),
}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_in_proportion(name):
    t = TEXTS[name]
    net, scorer, weights = language.Network(6), moderation.Scorer(np.zeros(moderation.BUCKETS, dtype=np.float32), -3.0), personal.fitted()
    for f in (
        lambda: sentences.spans(sentences.plain(t)), lambda: split.spans(t), lambda: encode.windows(t), lambda: encode.boundaries([t]), lambda: encode.pieces([t]), lambda: language.stretches(net, [t]), lambda: scorer([t]),
        lambda: near.Shingler()([t]), lambda: personal.find(t, weights), lambda: reading.windows(t),
    ):
        began = time.process_time()
        f()
        assert time.process_time() - began < 6, (name, f.__code__.co_names)
