import re
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.functions import refs, text, vectors
from murmura.settings import Settings

SENTENCE = "Bitte merkt euch @nordlicht7 jetzt https://verein.example/p/9 den Abend im neuen Saal am Hafen bei Anna Wolke"
CLEANED = [
    ("Moin", "Moin", 4), ("@a1 @b_2 @c", " ", 0), ("https://x.example http://y.example/z", " ", 0), ("   ", " ", 0),
    (SENTENCE, "Bitte merkt euch jetzt den Abend im neuen Saal am Hafen bei Anna Wolke", 57),
    ("Grüße @kai und @mia_k, kommt bald", "Grüße und kommt bald", 17),
    ("Seht http://x.example und https://y.example mal an", "Seht und mal an", 12),
    ("Folgt t.me/hafenfest oder T.ME/Saal", "Folgt oder ", 9),
    ("Nimm bit.ly/7h oder goo.gl/9k", "Nimm oder ", 8),
    ("Zahlt auf DE12 3456 7890 1234 5678 90 ein", "Zahlt auf ein", 11),
    ("Hoi @kai zie https://x.example en rekening DE09876543210987654321", "Hoi zie en rekening ", 16),
    ("Na, Ihr! @#$", "Na, Ihr! ", 5), ("Saal7 Tor12", "Saal7 Tor12", 10), ("t.me/@kai x", "t.me/ x", 4),
    ("a@b.c d", "a d", 2), ("HTTPſ://x.y z", " z", 1), ("a b\x1cc\x85d", "a b c d", 4), ("x" * 50, "x" * 50, 50), ("x" * 49, "x" * 49, 49),
    ("一é😀", "一é😀", 3), ("", "", 0), (None, None, None),
]


def test_cleaning_and_length(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CLEANED)], "i int, t string").withColumn("c", text.clean(F.col("t"))).withColumn("n", text.alnum_length(F.col("c")))
    for r in df.collect():
        assert (r.c, r.n) == CLEANED[r.i][1:], CLEANED[r.i]
    errors = {r.n: r.e for r in df.select("n", text.length_error(F.col("n"), 50).alias("e")).collect()}
    assert errors[50] is None and errors[49] == errors[0] == "Text too short" and errors[None] is None
    zero = spark.range(1).select(text.length_error(F.lit(0), 0).alias("e")).first().e
    assert zero == "Text empty after preprocessing"


def test_numeral_letters_follow_the_rule():
    want = {chr(c) for c in range(0x110000) if chr(c).isalpha() and chr(c).isnumeric() and unicodedata.category(chr(c)) == "Lo"}
    assert set(text.NUMERAL_LETTERS[1:-1]) == want


def test_strip_and_transcription(spark):
    cases = [([" ä", "b \n"], "äb"), ([], None), ([""], None), ([" ", "\t"], ""), (None, None)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s array<string>")
    assert {r.i: r.t for r in df.select("i", text.transcription_text(F.col("s")).alias("t")).collect()} == {i: t for i, (_, t) in enumerate(cases)}


def test_refs(spark):
    cases = [
        (None, False, None, None), ([], False, None, None), ([None], False, None, None), ([("Thumbnails", "t/1")], True, None, None),
        ([("thumbnails", "t"), ("voices", "a/b.ogg")], True, None, "voices/a/b.ogg"), ([("photos", "p/1"), ("photos", "p/2")], True, "p/1", "photos/p/1"),
        ([("voices", None), ("audios", "x")], True, None, None), ([(None, None)], False, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, r array<struct<bucket:string,object:string>>")
    for row in df.select("i", refs.exists_any(F.col("r")).alias("e"), refs.photo_object(F.col("r")).alias("p"), refs.media_path(F.col("r")).alias("m")).collect():
        assert (row.e, row.p, row.m) == cases[row.i][1:], cases[row.i]
    one = spark.range(1).select(refs.bucket_of(F.lit("a/b/c")).alias("b"), refs.object_of(F.lit("a/b/c")).alias("o"), refs.file_name(F.lit("a/b/c")).alias("f"), refs.chat_of_table(F.lit("vec_msgs_12")).alias("c")).first()
    assert tuple(one) == ("a", "b/c", "c", "12")


def test_vectors(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [-3.0, -4.0]), (7, [4.0, -3.0])], "i int, v array<float>")
    assert {r.i for r in df.where(vectors.usable(F.col("v"), 2)).collect()} == {0, 6, 7}
    assert df.where("i = 0").select(vectors.l2_normalized(F.col("v")).alias("n")).first().n == pytest.approx([0.6, 0.8])
    assert df.where("i = 1").select(vectors.l2_normalized(F.col("v")).alias("n")).first().n is None


def test_normalizing_takes_time_in_proportion_to_the_length(spark):
    x = np.random.default_rng(1).normal(size=20_000).astype(np.float32)
    df = spark.createDataFrame([(x.tolist(),)], "v array<float>").select(vectors.l2_normalized(F.col("v")).alias("n"))
    began = time.time()
    n = df.first().n
    assert time.time() - began < 10  # a sum of all squares for each value takes over half a minute
    assert n == pytest.approx((x.astype(float) / np.linalg.norm(x.astype(float))).tolist())


def test_settings():
    assert Settings(image_model="openai/clip-vit-large-patch14", image_dimension=5).image_dimension == 768
    for wrong in ({"text_embedding_fields": ("title",)}, {"classification_fields": ("attachment",)}, {"image_attachment_types": ("video",)}, {"asr_model": "huge"}, {"storage_provider": "aws"}, {"image_model": "x"}):
        with pytest.raises(ValueError):
            Settings(**wrong)
    assert Settings(storage_provider="aws", storage_region="r").storage_region == "r"
    env = Settings.from_env({"CLASSIFICATION_LANGUAGES": '["de","en"]', "TEXT_BATCH": "7", "USE_GPU": "true"})
    assert (env.classification_languages, env.text_batch, env.use_gpu) == (("de", "en"), 7, True)
    assert refs.endpoint(Settings()) == "http://minio:9000" and refs.endpoint(Settings(storage_use_ssl=True)) == "https://minio:9000"
    assert refs.endpoint(Settings(storage_endpoint="https://s.example")) == "https://s.example" and refs.endpoint(Settings(storage_provider="aws", storage_region="r")) is None
    assert refs.bucket_name("photos", Settings(storage_bucket_prefix="x-")) == "x-photos"
    assert re.fullmatch(text.IBAN.replace(text.SPACE, r"\s"), "DE12 3456 7890 1234 5678 90")
