import os

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from murmura.llm import encode, vocab

pytestmark = pytest.mark.skipif(not os.path.exists(vocab.FOLDER), reason="no vocabulary files")
ALPHABET = "ab '1 \n\tsétmdrvel😀.!²½\u00a0\u3000中"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), max_size=6))
def test_boundaries_are_those_of_the_pattern(texts):
    begins, starts = encode.boundaries(texts)
    for t, a, b in zip(texts, starts, starts[1:]):
        assert np.flatnonzero(begins[a:b]).tolist() == [m.start() for m in regex.finditer(vocab.PATTERN, t)]


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=0, max_size=200))
def test_boundaries_of_any_text(text):
    begins, _ = encode.boundaries([text])
    assert np.flatnonzero(begins).tolist() == [m.start() for m in regex.finditer(vocab.PATTERN, text)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, min_size=0, max_size=300))
def test_pieces_and_parts_equal_whole(text):
    enc = vocab.encoding()
    whole = enc.encode_ordinary(text)
    assert encode.ids_of(enc, [text, None, text], 40, 12) == [whole, [], whole]
    w = encode.windows(text, 80, 12)
    parts = [dict(zip(("window", "ids", "cut", "head", "before"), (x, *encode.part(enc, x, k == len(w) - 1, 80, 12, 30)))) for k, x in enumerate(w)]
    assert encode.stitch(parts, enc, 80) == whole
    assert encode.decode(whole) == text


def test_most_pieces_are_windows():
    text = "Ein Satz mit Wörtern, it's 12:30 o'clock! " * 400
    found = encode.pieces([text, "kurz"])
    assert "".join(found[0]) == text and len(found[0]) == -(-len(text) // encode.CHUNK) and found[1] == ["kurz"]


def test_rows(spark):
    enc = vocab.encoding()
    texts = ["", None, "Hallo Welt <|endoftext|> it's", "lorem ipsum, dolor! " * 300, "x" * 3000, "\n" * 900 + "ein Wort " * 200, " " * 500 + "a", "ab " * 500 + "y" * 900 + " z" * 900]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "again")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode.encode(df, chunk=128, overlap=32, spread=512).collect())
    assert got == sorted([(i, enc.encode_ordinary(t or "")) for i, t in enumerate(texts)] + [(3, enc.encode_ordinary(texts[3]))])
    assert {r.doc_id: r.n_tokens for r in encode.sizes(df, spread=512).collect()} == {i: len(x) for i, x in got}
    assert encode.encode(df.limit(0)).count() == 0
