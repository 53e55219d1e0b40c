import random

import numpy as np

from murmura.llm import moderation

GOOD = ["The council plans a new bridge near {}.", "We still have {} seats free.", "My neighbour likes the shop in {}.", "A film about an idiot opens in {}.", "The train to {} leaves late."]
BAD = ["You are a worthless idiot, leave {}.", "Only a moron like you believes {}.", "Go away from {}, you filthy scum."]


def message(rng, bad):
    place = lambda: "".join(rng.choice("aeiourstlm") for _ in range(6)).capitalize()
    out = [rng.choice(GOOD).format(place()) for _ in range(3)]
    if bad:
        out[rng.randrange(3)] = rng.choice(BAD).format(place())
    return " ".join(out)


def words(text):
    return [w for s in moderation.sentences(moderation._joined(text.lower())) for w in map(moderation.normal, s) if w]


def test_normal_forms():
    assert words("v0ll1d10t !!! f.i.d.d.l.e sooooo Ünï") == ["vollidiot", "fiddle", "so", "uni"]
    assert words("іdiоt") == words("idiot")
    assert words("123 👍 !!!") == []


def test_scores(spark):
    rng = random.Random(2)
    rows, labels, truth = [], [], {}
    for k in range(600):
        bad = k % 4 == 0
        t = message(rng, bad)
        field = (t, None) if k % 3 else (None, t)
        rows.append((f"m{k:03d}", *field, f"c{k % 5}", 0.0))
        truth[f"m{k:03d}"] = bad
        if k < 400:
            labels.append((f"m{k:03d}", int(bad if rng.random() > 0.05 else not bad), "x" if bad else None, "a"))
    rows += [("null", None, None, None, 1.0), ("empty", "", " ", "c0", 1.0), ("dis", "You are a worthless 1d10t, leave town.", None, "c1", 1.0), ("dis", "You are a worthless 1d10t, leave town.", None, "c1", 1.0), ("long", "We still have seats free. " * 4000, None, "c2", 1.0)]
    df = spark.createDataFrame(rows, "id string, text string, caption string, chat_id string, score double")
    lab = spark.createDataFrame(labels, "message_id string, abusive int, category string, annotator string")
    scored = moderation.scores(df, lab)
    got = {r.message_id: r for r in scored.collect()}
    assert np.mean([got[i].abusive == b for i, b in truth.items()]) > 0.93
    assert got["null"].score == got["empty"].score == 0 and got["null"].field is None and got["dis"].abusive and not got["long"].abusive
    found = [r.message_id for r in moderation.found(scored).collect()]
    assert len(found) == len(set(found)) and "dis" in found
    rates = {r.chat_id: r for r in moderation.rates(scored).collect()}
    assert set(rates) == {"c0", "c1", "c2", "c3", "c4", None} and sum(r.messages for r in rates.values()) == 604
    assert moderation.found(moderation.scores(df, lab.limit(0))).count() == 0
    assert moderation.scores(df.limit(0), lab).count() == 0


def test_short_replies_without_labels(spark):
    """Replies that no label covers are not flagged: messages without a label are presumed harmless, few n-grams say little."""
    rng = random.Random(5)
    rows = [(f"m{k:03d}", message(rng, k % 4 == 0), None, "c") for k in range(400)]
    replies = ["Yes, fine.", "No, sorry", "See you soon", "Thanks!", "Great", "Okay 👍"]
    rows += [(f"r{k:03d}", replies[k % len(replies)], None, "c") for k in range(120)]
    df = spark.createDataFrame(rows, "id string, text string, caption string, chat_id string")
    labels = spark.createDataFrame([(f"m{k:03d}", int(k % 4 == 0)) for k in range(400)] + [("m000", 0), ("m000", 1)], "message_id string, abusive int")
    got = {r.message_id: r.abusive for r in moderation.scores(df, labels).collect()}
    assert not any(got[f"r{k:03d}"] for k in range(120))
    assert np.mean([got[f"m{k:03d}"] == (k % 4 == 0) for k in range(400)]) > 0.97
    assert not any(r.abusive for r in moderation.scores(df.where("id like 'r%'"), labels.limit(0)).collect())


def test_short_sentences_join():
    assert [len(s) for s in moderation.sentences("i. a. anna lund. we meet at noon today. ok.")] == [4, 6]
    assert moderation.windows(0) == [] and moderation.windows(16) == [(0, 16)] and moderation.windows(21)[-1] == (9, 21)
