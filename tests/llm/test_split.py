from hypothesis import given, settings
from hypothesis import strategies as st

from murmura.llm import split


def check(text, limit, overlap):
    got = split.spans(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b in got:
        assert 0 < b - a <= limit
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c < b and d > b and abs(b - c - overlap) <= overlap // 2 + 17
    return got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!é́😀‍", min_size=41, max_size=400))
def test_cover_and_overlap(text):
    check(text, 40, 8)


def test_natural_ends():
    text = ("Ein Satz mit ein paar Wörtern. " * 100).strip()
    for _, b in check(text, 1200, 100)[:-1]:
        assert text[:b].endswith(". ")
    paragraphs = "\n\n".join(["wort " * 150] * 5)
    assert paragraphs[: check(paragraphs, 1200, 100)[0][1]].endswith("\n\n")
    check("x" * 5000, 1200, 100)


def test_rows(spark):
    t = "Wort und Satz. " * 200
    df = spark.createDataFrame(
        [("a", t, None, "x"), ("a", t, None, "x"), ("b", None, (t,), None), ("c", "", ("",), None), ("d", "é" * 1200, None, None), (None, t, None, None)],
        "id string, text string, attachment struct<transcription:string>, piece string",
    )
    rows = split.pieces(split.long_items(df)).collect()
    assert {(r.message_id, r.source_field) for r in rows} == {("a", "text"), ("b", "attachment.transcription"), (None, "text")}
    assert len({(r.message_id, r.piece_no) for r in rows}) == len(rows)
    assert all(r.piece == t[r.start : r.end] for r in rows)
    assert split.pieces(split.long_items(df.limit(0))).count() == 0
