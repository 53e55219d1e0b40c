import numpy as np

from murmura.llm import nearest


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n // 25, dim))[rng.integers(0, n // 25, n)] + 0.6 * rng.standard_normal((n, dim))


def test_scan_misses_little():
    x = clustered(900, 384, 1)
    want, s = brute(x, 10)
    i, j, c = nearest.scan(x[:300], np.arange(300), x, np.arange(900), 10)
    got = {}
    for a, b, v in zip(i, j, c):
        got.setdefault(a, set()).add(b)
        assert abs(s[a, b] - v) < 1e-9
    assert np.mean([len(got[a] & set(want[a])) / 10 for a in range(300)]) > 0.99


def test_recall_and_dirty_rows(spark):
    dim = 48
    x = clustered(1500, dim, 2).astype(np.float32)
    x[7] *= 30
    x[11] = x[10]
    rows = [(i, [float(v) for v in r], "clash") for i, r in enumerate(x)]
    bad = [None, [], [1.0] * 5, [0.0] * dim, [float("nan")] * dim, [None] * dim, [float("inf")] + [1.0] * (dim - 1)]
    df = spark.createDataFrame(rows + [(9000 + i, v, None) for i, v in enumerate(bad)], "vec_id bigint, vector array<float>, id string").repartition(4)
    want, _ = brute(x.astype(float), 10)
    for block in (20_000, 40):
        got = {}
        for r in nearest.nearest(df, dim, per_list=100, block=block).collect():
            got.setdefault(r.id, []).append(r.neighbour)
        assert set(got) == set(range(1500)) and all(len(v) == len(set(v)) == 10 and k not in v for k, v in got.items())
        assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in range(1500)]) > 0.95
    assert nearest.nearest(df.limit(0), dim).count() == 0
    few = nearest.pairs(nearest.nearest(df.where("vec_id < 3"), dim)).collect()
    assert {tuple(r) for r in few} == {(0, 1), (0, 2), (1, 2)}


def test_a_vector_that_many_rows_share(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 16))
    rows = [(i, [float(v) for v in x[0 if i < 400 else i % 60]]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<float>").repartition(5)
    got = {}
    for r in nearest.nearest(df, 16, k=10).collect():
        got.setdefault(r.id, []).append((r.neighbour, r.similarity))
    assert set(got) == set(range(600)) and all(len(v) == len({a for a, _ in v}) == 10 for v in got.values())
    assert all(i not in [a for a, _ in v] for i, v in got.items())
    assert all(s > 1 - 1e-6 for i in range(400) for _, s in got[i])


def found_share(spark, x, k=10, **how):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, vector array<float>").repartition(4)
    want, _ = brute(x.astype(np.float32).astype(float), k)
    got = {}
    for r in nearest.nearest(df, x.shape[1], k, **how).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    return np.mean([len(got[i] & set(want[i])) / k for i in range(len(x))])


def test_recall_on_data_of_low_rank_and_without_structure(spark):
    """Lists probed as far as measured need be: low rank needs more of them than clusters, evenly spread vectors are compared in full."""
    rng = np.random.default_rng(6)
    low = rng.standard_normal((2500, 6)) @ rng.standard_normal((6, 64))
    even = rng.standard_normal((2500, 64))
    assert found_share(spark, low, per_list=50) > 0.97
    assert found_share(spark, even, per_list=50) > 0.999
    assert found_share(spark, even[:400], exact=True) > 0.999


def test_rule_is_the_narrowest_that_reaches_the_target():
    rng = np.random.default_rng(7)
    s = rng.uniform(-0.2, 1, (300, 40))
    asked = np.repeat(np.arange(300), 5)
    lists = np.argsort(-s, axis=1)[:, :8][asked, rng.integers(0, 8, 1500)]
    rule, cost, share = nearest.set_rule(s, asked, lists, 0.9)
    assert share >= 0.9 and 1 <= cost < 40
    x, c = nearest.unit(rng.standard_normal((50, 8))), nearest.unit(rng.standard_normal((12, 8)))
    rows, found = nearest.probes(x, c, rule)
    assert (found[np.searchsorted(rows, np.arange(50))] == (x @ c.T).argmax(1)).all() and len(set(zip(rows, found))) == len(rows)
    everything, _ = nearest.probes(x, c, (1.0, 5.0))
    assert len(everything) == 600


def test_number_of_lists_grows_with_the_root():
    assert nearest.number_of_lists(100) == 1 and nearest.number_of_lists(256_000) == 1000
    assert nearest.number_of_lists(4 * 256 * 4096) == 2 * 4096 and nearest.number_of_lists(100 * 256 * 4096) == 10 * 4096
    x = nearest.unit(np.random.default_rng(1).standard_normal((9000, 8)))
    c = nearest.centroids(x, 3000, rounds=2)
    assert 2500 < len(c) < 3500 and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5)
