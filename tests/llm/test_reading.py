import random

import numpy as np

from murmura.llm import reading

EASY, PLAIN, HARD = "the cat has a red hat and dad sees it now".split(), "council village timetable reports meeting yesterday neighbours bridge compare station".split(), "epistemological institutionalisation presupposes longitudinal constitutional proportionality delegitimisation considerations jurisprudential methodological".split()


def document(rng, level, n=8):
    pool = (EASY, PLAIN + EASY, HARD + PLAIN[:3])[level - 1]
    return " ".join(" ".join(rng.choice(pool) for _ in range(12)).capitalize() + rng.choice([".", "!", "\n", ""]) for _ in range(n))


def test_running_text():
    assert reading.sentences("aaaaaaaa Ein Satz. https://x.example/a @du\n2025-01-01T00:00:00Z INFO ok\n{\"a\": 1}\n12 34 56 a\nInfo für alle") == [["ein", "satz"], ["info", "für", "alle"]]
    assert sum(map(len, reading.windows("wort " * 100))) == 100


def test_levels(spark):
    rng = random.Random(3)
    rows, labels, truth = [], [], {}
    for k in range(240):
        truth[k] = k % 3 + 1
        rows.append((k, document(rng, truth[k]), 0.5))
        if k < 120:
            labels.append((k, truth[k] if rng.random() > 0.05 else rng.randint(1, 3), "a"))
    rows += [(900, None, 0.0), (901, "", 0.0), (902, " \n", 0.0), (903, "https://a.example/b " * 100, 0.0), (904, "the cat " * 19, 0.0), (905, "the cat has a hat. " * 9000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, p1 double")
    lab = spark.createDataFrame(labels, "doc_id bigint, reading_level int, annotator string")
    got = {r.doc_id: r for r in reading.levels(docs, lab).collect()}
    assert len(got) == len(rows) and np.mean([got[k].reading_level == y for k, y in truth.items()]) > 0.95
    assert all(got[k].reading_level is None and got[k].difficulty is None for k in (900, 901, 902, 903, 904)) and got[905].reading_level == 1
    assert abs(got[0].p1 + got[0].p2 + got[0].p3 - 1) < 1e-9
    assert reading.levels(docs.limit(0), lab).count() == 0
    assert reading.levels(docs, lab.limit(0)).count() == len(rows)
