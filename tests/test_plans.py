"""What the planner makes of the operators: filters at the scan, few columns read, no full sort for a top-k."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import oracles
from murmura.operators import filters, incremental, metrics, search
from murmura.sources import vectors
from murmura.sources.tables import table

pytestmark = pytest.mark.skipif(not os.path.isdir(oracles.SF), reason="no test tables")


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_nested_predicates_reach_the_scan(spark):
    p = plan(table(spark, oracles.SF, "messages").where(filters.unprocessed_audio() & filters.after(dt.datetime(2025, 1, 1))).select("id"))
    assert "IsNull(attachment.transcription_status)" in p, p and "In(attachment.type" in p and "GreaterThan(date" in p
    assert "storage_refs" not in p.split("ReadSchema")[-1]


def test_top_k_takes_heads_only(spark):
    v = table(spark, oracles.SF, "text_vectors")
    p = plan(search.knn(v, [1.0] * 384, 10, filters.in_chats([1, 2])))
    assert "TakeOrderedAndProject" in p and "In(chat_id" in p and "source_field" not in p.split("ReadSchema")[-1]


def test_watermarks_are_aggregated_before_they_travel(spark):
    p = plan(incremental.after_watermark(table(spark, oracles.SF, "messages"), table(spark, oracles.SF, "text_vectors")))
    assert "partial_max(date" in p and "vector" not in p.split("ReadSchema")[-1]


def test_counts_on_the_way(spark):
    df, seen = metrics.counted(spark.range(10), even=F.col("id") % 2 == 0)
    df.collect()
    assert seen.get == {"total": 10, "even": 5}
    result, seconds = metrics.timed(lambda: 7)
    assert result == 7 and seconds >= 0


def test_attempts(spark, tmp_path):
    tries = []

    def sometimes():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("away")

    vectors.attempt(sometimes, wait_s=0)
    assert len(tries) == 3
    with pytest.raises(ValueError):
        vectors.attempt(lambda: (_ for _ in ()).throw(ValueError("bad row")), wait_s=0)
    with pytest.raises(OSError):
        vectors.attempt(lambda: (_ for _ in ()).throw(OSError("away")), attempts=2, wait_s=0)
    path = str(tmp_path / "v")
    assert vectors.create(spark, path, "chat_id string, vector array<float>") and not vectors.create(spark, path, "chat_id string, vector array<float>")


def test_search_of_images_normalizes(spark):
    df = spark.createDataFrame([("a", [0.6, 0.8])], "message_id string, vector array<float>")
    assert search.search_images(df, "x", lambda t: [30.0, 40.0]).first().score == pytest.approx(1.0)
    with pytest.raises(ValueError):
        search.search_images(df, "x", lambda t: [0.0, 0.0])
