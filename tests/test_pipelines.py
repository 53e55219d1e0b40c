import datetime as dt
import struct
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura import models
from murmura.functions.media import image_header
from murmura.operators import filters, incremental, mutate, search
from murmura.plans import classify, embed_images, embed_text, transcribe
from murmura.schemas import IMAGE_VECTORS, MESSAGES, TEXT_VECTORS
from murmura.settings import Settings
from murmura.sources import blobs, vectors
from murmura.sources.tables import table
from murmura.streaming import runs

DAY = dt.datetime(2025, 1, 1)
PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x08\0\0\0\x04\x08\x02\0\0\0"
LONG = "Das ist ein ausreichend langer deutscher Satz, der sicher mehr als fünfzig Zeichen hat."


def message(i, text=None, caption=None, language="de", attachment=None, classification=None, chat="c1", day=0):
    return (i, chat, DAY + dt.timedelta(days=day), language, text, caption, attachment, classification)


def attachment(kind, refs, status=None, transcription=None):
    return (kind, refs, transcription, status, None, None)


@pytest.fixture(scope="module")
def messages(spark):
    done = (True, 0.7, None, DAY)
    voice = [("thumbnails", "t/1"), ("voices", "v/1.ogg")]
    rows = [
        message("a", LONG), message("b", None, LONG, day=1), message("c", LONG, LONG, day=2), message("d"), message("e", LONG, language="en"), message("f", LONG, classification=done),
        message("g", "kurz", day=3), message("h", "", day=3), message("i", None, "", day=3, chat=None),
        message("v1", attachment=attachment("voice", voice)), message("v2", attachment=attachment("audio", [("audios", "gone.mp3")])), message("v3", attachment=attachment("voice", voice, "PENDING")),
        message("v4", attachment=attachment("voice", voice, "SUCCESS", "Text")), message("v5", attachment=attachment("voice", [("thumbnails", "t")])), message("v6", attachment=attachment("voice", [("voices", "empty.ogg")])),
        message("p1", None, "Bild", attachment=attachment("photo", [("photos", "p/1.jpg")]), day=4), message("p2", attachment=attachment("photo", [])), message("p3", attachment=attachment("photo", [("photos", "none.jpg")]), day=5), message("p4", attachment=attachment("photo", [("photos", "bad.jpg")]), day=5),
    ]
    return spark.createDataFrame(rows, MESSAGES)


@pytest.fixture(scope="module")
def media(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("media")
    for path, content in (("voices/v/1.ogg", b"sound"), ("voices/empty.ogg", b"\0\0"), ("photos/p/1.jpg", PNG), ("photos/bad.jpg", b"no picture")):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    return str(root)


def test_classification(spark, messages):
    assert {r.id for r in classify.pending(messages).collect()} == {"a", "b", "g", "p1"}
    multi = messages.where(filters.unclassified(allow_multi=True))
    assert {r.id for r in multi.collect()} == {"a", "b", "c", "g", "h", "i", "p1"}
    after = {r.id: r.classification for r in classify.run(messages).collect()}
    assert after["g"].error == "Text too short" and after["g"].classified is False and after["g"].score_pos is None
    assert after["a"].classified and after["a"].score_pos == pytest.approx(models.probability(LONG)) and after["f"].score_pos == 0.7 and after["e"] is None
    again = classify.run(messages)
    assert classify.pending(again).count() == 0  # a second run has nothing to do
    assert mutate.clear_classification(again).where("classification is not null").count() == 0
    assert classify.run(messages.limit(0)).count() == 0
    scores = spark.createDataFrame([(0.5,), (0.51,), (None,)], "score_pos double")
    assert tuple(models.tally(scores).first()) == (1, 1)


def test_model_registry(tmp_path):
    assert models.resolve("standin", kind="classifier", load=False) is None
    with pytest.raises(RuntimeError):
        models.resolve("standin", str(tmp_path), download_allowed=False)
    (tmp_path / "standin").mkdir()
    assert models.resolve("standin", str(tmp_path), download_allowed=False, load=False) == str(tmp_path / "standin")
    with pytest.raises(KeyError):
        models.resolve("unknown")
    with pytest.raises(ValueError):
        models.checked_labels([{"label": "x"}], 1)
    assert [models.positive_score is not None, models.resolve("standin", kind="classifier")(["a", "b"])[0].keys() == {"label", "score"}] == [True, True]


def test_embedding_and_search(spark, messages):
    rows = embed_text.embed(messages)
    got = {(r.message_id, r.source_field): r.vector for r in rows.collect()}
    assert ("h", "text") not in got and ("i", "caption") not in got and ("c", "caption") in got
    assert np.allclose(got[("a", "text")], models.hashed_vector(LONG, 384))
    settings = Settings(text_embedding_fields=("text", "attachment.transcription"))
    assert ("v4", "attachment.transcription") in {(r.message_id, r.source_field) for r in embed_text.embed(messages, settings).collect()}
    hits = search.search_text(rows, LONG, models.encode_query, 3)
    found = [(r.id, r.score) for r in hits.collect()]
    assert {i for i, _ in found} <= {"a", "b", "c", "e", "f"} and found[0][1] == pytest.approx(1) and len({i for i, _ in found}) == len(found)
    one = search.search_text(rows, LONG, models.encode_query, 10, date_from=DAY + dt.timedelta(days=1), date_to=DAY + dt.timedelta(days=2), chat_ids=["c1"])
    assert [r.id for r in one.collect()] == ["b"]
    for bad in (("", 5), (" ", 5), ("x", 0), ("x", 10_001)):
        with pytest.raises(ValueError):
            search.search_text(rows, bad[0], models.encode_query, bad[1])
    assert search.search_text(vectors.read(spark, f"/tmp/none-{uuid.uuid4().hex}", TEXT_VECTORS), "x", models.encode_query).count() == 0


def test_knn_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    df = spark.createDataFrame([(f"m{i // 2}", i, [float(v) for v in r]) for i, r in enumerate(x)], "message_id string, vec_id bigint, vector array<float>")
    q = rng.standard_normal(16)
    s = (1 + x.astype(np.float32).astype(float) @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)) / 2
    top = np.argsort(-s)[:40]
    want = {}
    for i in top:
        want.setdefault(f"m{i // 2}", s[i])
    got = [(r.id, r.score) for r in search.search(df, q.tolist(), 40, tie=("vec_id",)).collect()]
    assert [i for i, _ in got] == list(want) and np.allclose([v for _, v in got], list(want.values()), atol=1e-6)
    doubled = search.search(df.union(df), q.tolist(), 80).collect()
    assert [r.id for r in doubled] == list(want)  # a vector twice changes nothing


def test_images_and_speech(spark, messages, media):
    rows = {r.message_id: r for r in embed_images.embed(messages, media).collect()}
    assert set(rows) == {"p1", "p3", "p4"} and len(rows["p1"].vector) == 512 and rows["p3"].vector is None and rows["p3"].error.startswith("no file") and rows["p4"].error == "unreadable image"
    joined = {r.message_id: r.vector for r in embed_images.embed(messages, blobs.media(spark, media)).collect()}
    assert joined == {i: r.vector for i, r in rows.items()}  # a table of contents gives the same
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    assert all(abs((now - r.processed_at).total_seconds()) < 600 for r in rows.values())
    assert abs((now - embed_text.embed(messages).first().processed_at).total_seconds()) < 600
    assert search.search_images(embed_images.embed(messages, media), "Bild", lambda q: models.encode_query(q, "standin-joint")).first().id == "p1"
    assert set(c for c in embed_images.embed(messages, media).columns) >= {f.split()[0] for f in IMAGE_VECTORS.split(", ")}
    chosen = transcribe.open_media(messages)
    assert {tuple(r) for r in chosen.collect()} == {("v1", "voices/v/1.ogg"), ("v2", "audios/gone.mp3"), ("v6", "voices/empty.ogg")}
    after = {r.id: r.attachment for r in transcribe.run(messages, media).collect()}
    assert after["v1"].transcription_status == "SUCCESS" and after["v1"].transcription == "text of 5 bytes" and after["v1"].transcription_language == "de"
    assert after["v2"].transcription_status == "PENDING" and after["v6"].transcription_status == "SUCCESS" and after["v6"].transcription is None and after["v6"].transcription_language is None
    assert after["v4"].transcription == "Text" and after["a"] is None
    reset = {r.id: r.attachment for r in mutate.reset_pending(messages).collect()}
    assert reset["v3"].transcription_status is None and reset["v4"].transcription_status == "SUCCESS" and reset["a"] is None
    cleared = {r.id: r.attachment for r in mutate.clear_fields(messages).collect()}
    assert cleared["v4"].transcription is None and cleared["v4"].storage_refs is not None


def test_speech_outcomes(spark):
    rows = [(["a"], False, False), ([" "], False, False), ([], False, False), (["a"], True, False), (["a"], False, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s array<string>, n boolean, f boolean")
    got = [tuple(r)[1:] for r in df.select("i", *transcribe.outcome(F.col("s"), F.lit("de"), F.lit(0.5), F.col("n"), F.col("f"))).orderBy("i").collect()]
    assert got == [("SUCCESS", "a", "de", 0.5), ("SUCCESS", "", "de", 0.5), ("SUCCESS", None, None, None), ("SUCCESS", None, None, None), ("FAILURE", None, None, None)]


def test_incremental_modes(spark, messages):
    results = spark.createDataFrame([("a", "c1", DAY, "text"), ("b", "c1", DAY + dt.timedelta(days=1), "caption")], "message_id string, chat_id string, date timestamp_ntz, source_field string")
    by_mark = {r.id for r in incremental.after_watermark(messages.where(filters.to_embed()), results).collect()}
    assert by_mark == {"c", "g", "h", "i", "p1"}  # 'e' and 'f' are late: the watermark drops them
    parts = embed_text.explode_fields(messages).select("message_id", "source_field")
    by_key = {r.message_id for r in incremental.without_result(parts, results, ("message_id", "source_field")).collect()}
    assert {"e", "f"} <= by_key and not {"a", "b"} & by_key
    chats = incremental.chats_with_new(messages, results, F.col("attachment.type") == "photo")
    assert [tuple(r) for r in chats.collect()] == [("c1", DAY + dt.timedelta(days=1))]
    pages = {r.id: r.page for r in incremental.page_numbers(messages, 4).collect()}
    order = sorted((r.date, r.id) for r in messages.where("chat_id = 'c1'").collect())
    assert all(pages[i] == k // 4 for k, (_, i) in enumerate(order))
    assert filters.has_attachment_type(messages, "voice") and not filters.has_attachment_type(messages, "sticker")
    assert filters.has_field(messages, "attachment.storage_refs.bucket") and not filters.has_field(messages, "attachment.size")


def test_streams(spark, messages, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    messages.where("id < 'e'").coalesce(1).write.parquet(source)
    runs.embed_arrivals(spark, source, out, state)
    first = vectors.read(spark, out, TEXT_VECTORS).count()
    messages.where("id >= 'd'").coalesce(1).write.mode("append").parquet(source)
    runs.embed_arrivals(spark, source, out, state)
    every = vectors.read(spark, out, TEXT_VECTORS)
    assert 0 < first < every.count() == embed_text.embed(messages).count()
    runs.start_anew(spark, state)
    runs.embed_arrivals(spark, source, out, state)
    assert vectors.read(spark, out, TEXT_VECTORS).count() == every.count()  # what is there is not written again
    assert {r.chat_id for r in vectors.chats(every).collect()} == {"c1"}
    vectors.drop(spark, out)
    assert vectors.read(spark, out, TEXT_VECTORS).count() == 0


def test_files(spark, tmp_path):
    root = str(tmp_path / "store")
    names = blobs.ensure_buckets(spark, root, Settings(storage_bucket_prefix="x-"))
    assert "x-video-notes" in names and len(names) == 7 and blobs.exists(spark, f"{root}/x-photos")
    blobs.put(spark, f"{root}/x-photos/a/b.jpg", b"abc")
    assert [tuple(r) for r in blobs.media(spark, root).select("path", F.decode("content", "utf-8")).collect()] == [("x-photos/a/b.jpg", "abc")]
    assert blobs.delete(spark, f"{root}/x-photos/a/b.jpg") and not blobs.exists(spark, f"{root}/x-photos/a/b.jpg")


def test_knn_leaves_out_unusable_vectors_and_orders_ties(spark):
    bad = [None, [], [1.0], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [float("inf"), 1.0]]
    rows = [(f"x{i}", i, v) for i, v in enumerate(bad)] + [("b", 20, [1.0, 0.0]), ("a", 22, [2.0, 0.0]), ("a", 21, [3.0, 0.0]), (None, 23, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "message_id string, vec_id bigint, vector array<float>").repartition(3)
    hits = [tuple(r) for r in search.knn(df, [1.0, 0.0], 10, tie=("vec_id",)).collect()]
    assert hits == [("a", 1.0), ("a", 1.0), ("b", 1.0), (None, 0.5)]
    assert [r.id for r in search.knn(df, [1.0, 0.0], 2, tie=("vec_id",)).collect()] == ["a", "a"]
    assert search.knn(df.limit(0), [1.0, 0.0], 5).count() == 0


def test_image_headers():
    assert image_header(PNG) == ("png", 8, 4)
    assert image_header(b"GIF89a" + struct.pack("<HH", 3, 5)) == ("gif", 3, 5)
    assert image_header(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08" + struct.pack(">HH", 6, 7) + b"\x03") == ("jpeg", 7, 6)
    assert image_header(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + b"\x09\0\0\x04\0\0") == ("webp", 10, 5)
    for bad in (b"", b"text", PNG[:20], b"\xff\xd8\xff", b"GIF89a\0\0\0\0"):
        with pytest.raises(ValueError):
            image_header(bad)


def test_image_runs(spark, messages, media, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    messages.coalesce(1).write.parquet(source)
    first = runs.vectorize_arrivals(spark, source, media, out, state)
    assert first["total"] == 1 and first["batches"] == 1 and first["seconds"] > 0
    assert runs.vectorize_arrivals(spark, source, media, out, state + "2")["total"] == 0
    assert [r.message_id for r in vectors.read(spark, out, IMAGE_VECTORS).collect()] == ["p1"]
    counts = runs.classify_arrivals(spark, source, str(tmp_path / "c"), str(tmp_path / "cs"))
    assert counts["total"] == 4 and counts["failed"] == 2
    assert runs.alone(spark, state, lambda: runs.alone(spark, state, dict) or {"ran": 1}) == {"ran": 1}
    assert runs.alone(spark, state, lambda: {"ran": 2}) == {"ran": 2}
    waits = []
    runs.every(2, lambda: None, times=3, sleep=waits.append)
    assert len(waits) == 2 and all(119 < w <= 120 for w in waits)
    assert table(spark, str(tmp_path), "none", TEXT_VECTORS).count() == 0
    answer = search.timed_search(embed_text.embed(messages), LONG, models.encode_query, 3)
    assert answer["total"] == len(answer["hits"]) > 0 and answer["searching_s"] > 0
