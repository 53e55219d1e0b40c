import numpy as np
from pyspark.sql import functions as F

from murmura.operators import search
from murmura.sources import index


def test_index_finds_what_a_full_scan_finds(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 24))[rng.integers(0, 20, 800)] + 0.3 * rng.standard_normal((800, 24))
    bad = [None, [], [0.0] * 24, [float("nan")] * 24]
    rows = [(f"m{i}", i, f"c{i % 3}", [float(v) for v in r]) for i, r in enumerate(x)] + [(f"b{i}", 900 + i, "c0", v) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "message_id string, vec_id bigint, chat_id string, vector array<float>")
    path = str(tmp_path / "i")
    assert index.build(df, path, 24, lists=20) >= 15
    for seed in range(3):
        q = np.random.default_rng(seed).standard_normal(24).tolist()
        want = [tuple(r) for r in search.knn(df, q, 15, tie=("vec_id",)).collect()]
        assert [tuple(r) for r in index.search(spark, path, q, 15, probes=2, tie=("vec_id",)).collect()] == want
    some = F.col("chat_id") == "c1"
    assert [tuple(r) for r in index.search(spark, path, q, 15, probes=1, condition=some, tie=("vec_id",)).collect()] == [tuple(r) for r in search.knn(df, q, 15, some, tie=("vec_id",)).collect()]
    near = [x[k].tolist() for k in range(5)]
    assert index.recall(spark, path, near, 10, probes=4) > 0.9
    plan = index.search(spark, path, near[0], 5, probes=1, exact=False)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1][:60]
    empty = str(tmp_path / "e")
    assert index.build(df.limit(0), empty, 24) == 0 and index.search(spark, empty, near[0], 5).count() == 0
