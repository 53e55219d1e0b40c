import random

import numpy as np
from pyspark.sql import functions as F

from murmura.llm import language

WORDS = {
    "de": "der die und nicht ich mit auch werden schon über zwischen straße können heute morgen schule".split(),
    "en": "the and with that which they were from about would through thought school morning together".split(),
    "es": "los las que para con una por también desde hacia muchos años gente mañana escuela ciudad".split(),
    "fr": "les des avec pour dans une sont nous vous toujours leurs beaucoup école matin chez être".split(),
    "nl": "het een van niet met zijn voor ook maar wordt deze school morgen samen naar onze".split(),
    "ru": "это как так что они было только между школа утро вместе город люди очень когда потом".split(),
}


def sentence(rng, lang, n=10):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def corpus():
    rng = random.Random(4)
    rows = []
    for k in range(360):
        lang = language.LANGUAGES[k % 6]
        label = lang if rng.random() > 0.05 else rng.choice(language.LANGUAGES)
        rows.append((f"m{k:04d}", rng.choice([label, label.upper(), label + "-XX"]), " ".join(sentence(rng, lang) for _ in range(3)), lang))
    return rows


def test_spellings(spark):
    cases = {"de": "de", " DE ": "de", "de-AT": "de", "deu": "de", "fra": "fr", "pt_BR": "pt", "xx": None, "und": None, "unknown": None, "-": None, "": None, None: None, "rus": "ru"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r[0]: r[1] for r in df.select("l", language.stated(F.col("l"))).collect()} == cases


def test_best_paths_keeps_to_a_language_within_a_sentence():
    scores = np.array([[0.0, -6.0], [-2.0, 0.0], [0.0, -3.0], [-9.0, 0.0]])
    owner = np.zeros(4, dtype=int)
    assert language.best_paths(scores, owner, np.array([True, False, False, False])).tolist() == [0, 0, 0, 1]
    assert language.best_paths(scores, np.array([0, 1, 2, 2]), np.ones(4, dtype=bool)).tolist() == [0, 1, 0, 1]


def test_labels(spark):
    rng = random.Random(9)
    rows = corpus()
    mixed = sentence(rng, "de") + "\n" + sentence(rng, "ru", 12) + "\n" + sentence(rng, "de")
    extra = [("mix", "de", mixed), ("mix", "de", mixed), ("null", "de", None), ("empty", None, ""), ("signs", None, "!!! 123 @handle https://x.example/de"), ("none", "und", sentence(rng, "nl", 14)), (None, "de", mixed), ("long", "en", sentence(rng, "en") * 2000)]
    df = spark.createDataFrame([r[:3] + ("clash",) for r in rows] + [e + ("clash",) for e in extra], "id string, language string, text string, segments string")
    seg = language.segments(df)
    got = {r.message_id: r for r in language.label(seg).collect()}
    assert "null" not in got and got["signs"].verdict == got["empty"].verdict == "unknown"
    assert np.mean([got[i].lang == lang for i, _, _, lang in rows]) > 0.97
    assert [s.lang for s in got["mix"].segments] == ["de", "ru", "de"] and got["none"].verdict == "filled in"
    assert all(mixed[s.start : s.end].strip() for s in got["mix"].segments) and got["long"].verdict == "confirmed"
    found = [tuple(r) for r in language.found(seg).collect()]
    assert ("mix", "ru") in found and ("none", "nl") in found and len(found) == len(set(found))
    assert language.segments(df.limit(0)).count() == 0


def test_windows_keep_every_byte():
    """Sentences of mixed scripts, whose bytes are unevenly spread, and signs of three and four bytes."""
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(("abc ", "яжд ", "漢字", "😀", "é")) for _ in range(rng.randint(1, 200))).strip()
        x, places = language.lay_out([text])
        raw = b"".join(r[r != 0].tobytes() for r in x)
        assert raw == "".join(text[a:b] for _, a, b, _ in places).lower().encode()
    assert language.letters(language.lay_out(["漢字かな、。“” abc é я"])[0]).tolist() == [9]
