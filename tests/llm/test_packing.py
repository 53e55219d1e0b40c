import math
import random

import numpy as np

from murmura.llm import packing


def test_price_is_optimal():
    worth, counts = packing.price(np.array([3, 5, 7]), np.array([0.3, 0.6, 0.7]), 13)
    assert packing.price(np.array([3, 5, 7]), np.array([0.3, 0.6, 0.7]), 13, np.array([1, 1, 1]))[1].tolist() == [0, 1, 1]
    assert abs(worth - 1.3) < 1e-9 and counts.tolist() == [1, 2, 0] or abs(worth - 1.5) < 1e-9


def test_plan_holds_demand_in_few_containers():
    rng = random.Random(3)
    for cap, n in ((100, 3000), (64, 50), (7, 1)):
        sizes = [min(cap, max(1, int(rng.lognormvariate(math.log(cap / 4), 0.7)))) for _ in range(n)]
        s, d = np.unique(sizes, return_counts=True)
        planned, bound, program = packing.plan(s, d, cap, 120)
        held = {}
        for times, counts in planned:
            assert sum(a * b for a, b in counts.items()) <= cap
            for a, b in counts.items():
                held[a] = held.get(a, 0) + b * times
        assert held == dict(zip(s.tolist(), d.tolist()))
        used = sum(t for t, _ in planned)
        assert program >= 0.9 * used
        assert math.ceil(bound - 1e-6) <= used <= max(bound * 1.03, bound + 2)


def test_fill(spark):
    rows = [(i, (i * 7919) % 90) for i in range(500)] + [(1000, 250), (1001, None), (1002, 0), (1003, 100), (1004, 200)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    got = packing.fill(df, 100, rows=3, rounds=60).collect()
    load, docs = {}, {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.size
        docs.setdefault(r.doc_id, []).append((r.piece_no, r.size))
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    for i, n in rows:
        pieces = sorted(docs[i])
        assert [k for k, _ in pieces] == list(range(len(pieces))) and sum(s for _, s in pieces) == (n or 0)
        assert all(s == 100 for _, s in pieces[:-1]) and len(pieces) == max(1, -(-(n or 0) // 100))
    assert packing.fill(df.limit(0), 100).count() == 0
