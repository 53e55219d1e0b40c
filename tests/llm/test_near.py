import itertools
import random
import re

import numpy as np

from murmura.llm import near


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if i is not None and len(w) >= 20:
            sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def test_pairs_and_classes(spark):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(18, 60))] for _ in range(60)]
    rows = []
    for k in range(240):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.2:
            w = w[len(w) // 3 :] + w[: len(w) // 3]
        rows.append((f"m{k:03d}", " ".join(w) + ("!" if k % 2 else "")))
    rows += [("n", None), ("e", ""), (None, rows[0][1]), ("m000", rows[0][1]), ("copy", rows[0][1].upper()), ("long", "a b c d e f g " * 5000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "id string, content string, cls int")
    found = near.NearDuplicates(df.where("id is not null"))
    got = [tuple(r) for r in found.pairs().collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    reps = {tuple(r) for r in found.named_links().collect()}
    assert reps <= want and len(reps) > 10
    group, parent = {r.id: r.group_id for r in found.groups().collect()}, {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert {i: root(i) for i in group} == group and len(group) == len({i for i, t in rows if i and t and len(t.split()) >= 20})
    classes = {r.id: (r.class_id, r.n_links) for r in found.classes().collect()}
    assert classes["copy"] == classes["m000"] and classes["long"] == ("long", 0)
    assert near.NearDuplicates(df.limit(0)).pairs().count() == 0


def test_hot_bits_and_copies(spark):
    """A third of the rows share one text, others its opening: blocks of few rows give the same pairs."""
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(400)]
    opening = [rng.choice(vocab) for _ in range(24)]
    rows = [(f"c{k:03d}", " ".join(opening + vocab[:10])) for k in range(60)]
    rows += [(f"o{k:03d}", " ".join(opening[: rng.randint(12, 24)] + [rng.choice(vocab) for _ in range(rng.randint(8, 30))])) for k in range(120)]
    df = spark.createDataFrame(rows, "id string, content string")
    got = [tuple(r) for r in near.NearDuplicates(df, block=7).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_thresholds_sum_to_what_the_principle_asks():
    rng = np.random.default_rng(3)
    for threshold in (0.1, 0.5, 0.8):
        n = np.array([1, 17, 40, 95, 700, 3000])
        bounds = np.concatenate([[0], np.cumsum(n)])
        h = rng.integers(0, 1 << 62, n.sum()).astype(np.uint64)
        anchor = rng.integers(0, 1 << 62, 900).astype(np.uint64)[rng.integers(0, 900, n.sum())]
        counts = rng.integers(1, 40, n.sum()).astype(np.uint8)
        chosen = near.allocate(counts, h, anchor, bounds, threshold)
        need = n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(int) + 1
        got = np.add.reduceat(chosen, bounds[:-1])
        assert (got >= need).all()
        if threshold >= 0.5:
            assert (got[:4] == need[:4]).all()


def test_allocation_is_of_least_cost():
    """Against all ways to share the thresholds among the partitions of a small text."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        n = 9
        h, counts = rng.integers(0, 1 << 62, n).astype(np.uint64), rng.integers(1, 16, n).astype(np.uint8)
        anchor = rng.integers(0, 3, n).astype(np.uint64)
        chosen = near.allocate(counts, h, anchor, np.array([0, n]), 0.5)

        def cost(mask):
            return sum(max((int(counts[i]) - 1 for i in range(n) if mask[i] and anchor[i] == a), default=0) for a in range(3)) + near.POSTING * sum(mask[i] and counts[i] > 1 for i in range(n))

        def rarest(r):
            mask = [False] * n
            for a in range(3):
                for i in sorted((i for i in range(n) if anchor[i] == a), key=lambda i: (counts[i], h[i]))[: r[a]]:
                    mask[i] = True
            return mask

        sizes = [int((anchor == a).sum()) for a in range(3)]
        ways = [rarest(r) for r in itertools.product(*(range(s + 1) for s in sizes)) if sum(r) == chosen.sum()]
        assert abs(cost(chosen) - min(map(cost, ways))) < 1e-9


def test_contents(spark):
    df = spark.createDataFrame([("a", "t", "c"), ("b", "  \n", "c"), ("c", None, "c"), ("d", None, None), (None, "t", "c")], "id string, text string, caption string")
    assert {tuple(r) for r in near.message_contents(df).collect()} == {("a", "t"), ("b", "c"), ("c", "c")}
