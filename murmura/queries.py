"""Catalogue of the core's queries: name -> f(spark, directory of the tables), and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura import models
from murmura.functions import refs, text
from murmura.functions.vectors import l2_normalized, norm, usable
from murmura.operators import filters, incremental, mutate, nested, search
from murmura.plans import classify, embed_images, embed_text, transcribe
from murmura.schemas import IMAGE_VECTORS, TEXT_VECTORS
from murmura.sources import index, vectors
from murmura.sources.tables import checkpoint_dir, table
from murmura.streaming import runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.nodes(table(spark, sf_dir, "attachment_records"))


QUERIES["p5_found"] = lambda s, d: _nodes(s, d).where("kind <> 'other'").select("record_id", "node_path")
QUERIES["p5_attachments"] = lambda s, d: nested.attachments(_nodes(s, d))
QUERIES["p5_storage_refs"] = lambda s, d: nested.storage_refs(_nodes(s, d))
QUERIES["p5_variants"] = lambda s, d: nested.variants(_nodes(s, d))
QUERIES["p5_segments"] = lambda s, d: nested.segments(_nodes(s, d))
QUERIES["p5_words"] = lambda s, d: nested.words(_nodes(s, d))

#: The nodes by a recursive parse: what the structural index must find.
_LISTS_SQL = """CASE kind
  WHEN 'attachment' THEN [{n: 'items', k: 'attachment', v: j->'$.items'}, {n: 'storage_refs', k: 'storage_ref', v: j->'$.storage_refs'},
    {n: 'transcription.segments', k: 'segment', v: CASE WHEN json_type(j->'$.transcription') = 'OBJECT' THEN j->'$.transcription.segments' END}]
  WHEN 'storage_ref' THEN [{n: 'variants', k: 'variant', v: j->'$.variants'}]
  WHEN 'segment' THEN [{n: 'words', k: 'word', v: j->'$.words'}] ELSE [] END"""
_NODES_SQL = f"""
WITH RECURSIVE nodes AS (
  SELECT record_id, 'attachment' AS kind, 'attachment' AS node_path, CAST(NULL AS VARCHAR) AS parent_path, CAST(0 AS INTEGER) AS place, j
  FROM (SELECT record_id, CASE WHEN json_type(a) = 'VARCHAR' THEN TRY_CAST(a->>'$' AS JSON) ELSE a END AS j
        FROM (SELECT record_id, TRY_CAST(payload AS JSON)->'$.attachment' AS a FROM attachment_records))
  WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT record_id, l.k, node_path || '.' || l.n || '[' || (i - 1) || ']', node_path, CAST(i - 1 AS INTEGER), es[i]
  FROM (SELECT record_id, node_path, l, es, unnest(range(1, len(es) + 1)) AS i
        FROM (SELECT record_id, node_path, l, CASE json_type(l.v) WHEN 'ARRAY' THEN TRY_CAST(l.v AS JSON[]) WHEN 'OBJECT' THEN [l.v] ELSE [] END AS es
              FROM (SELECT record_id, node_path, unnest({_LISTS_SQL}) AS l FROM nodes)))
  WHERE json_type(es[i]) = 'OBJECT')
"""


def _value_sql(path: str, kind: str = "VARCHAR") -> str:
    text = f"CASE WHEN json_type(j->'$.{path}') NOT IN ('OBJECT', 'ARRAY') THEN j->>'$.{path}' END"
    return text if kind == "VARCHAR" else f"TRY_CAST({text} AS {kind})"


def _nodes_table(kind: str, **columns: str) -> str:
    return _NODES_SQL + "SELECT record_id, node_path, parent_path, place, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM nodes WHERE kind = '{kind}'"


ORACLES["p5_found"] = _NODES_SQL + "SELECT record_id, node_path FROM nodes"
ORACLES["p5_attachments"] = _nodes_table(
    "attachment", type=_value_sql("type"), transcription_status=_value_sql("transcription.status"),
    transcription_language=f"coalesce({_value_sql('transcription.language.code')}, {_value_sql('transcription.language')})", transcription_language_probability=_value_sql("transcription.language.probability", "DOUBLE"),
)
ORACLES["p5_storage_refs"] = _nodes_table("storage_ref", bucket=_value_sql("bucket"), object=_value_sql("object"), md5=_value_sql("checks.md5"), bytes=_value_sql("checks.bytes", "BIGINT"))
ORACLES["p5_variants"] = _nodes_table("variant", bucket=_value_sql("bucket"), object=_value_sql("object"), width=_value_sql("size.w", "BIGINT"), height=_value_sql("size.h", "BIGINT"))
ORACLES["p5_segments"] = _nodes_table("segment", start=_value_sql("start", "DOUBLE"), text=_value_sql("text"))
ORACLES["p5_words"] = _nodes_table("word", w=_value_sql("w"), p=_value_sql("p", "DOUBLE"))
QUERIES["p5_message_refs"] = lambda s, d: nested.message_refs(table(s, d, "messages"))
ORACLES["p5_message_refs"] = """
SELECT DISTINCT id AS message_id, CAST(i - 1 AS INTEGER) AS place, attachment.storage_refs[i].bucket AS bucket, attachment.storage_refs[i].object AS object
FROM (SELECT id, attachment, unnest(range(1, len(attachment.storage_refs) + 1)) AS i FROM messages)
WHERE attachment.storage_refs[i] IS NOT NULL
"""


# --- search -----------------------------------------------------------------------------------------------------------


def _first_vector(vectors: DataFrame, dim: int) -> list[float]:
    """The stored vector that the search queries ask with: the usable one of the least id."""
    row = vectors.where(usable(F.col("vector"), dim)).orderBy("vec_id").select("vector").first()
    return [float(x) for x in row["vector"]] if row else [1.0] + [0.0] * (dim - 1)


def _usable_sql(dim: int) -> str:
    return f"len(vector) = {dim} AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"


def _knn_sql(name: str, dim: int, size: int, where: str = "TRUE", collapse: bool = True) -> str:
    ask = f"(SELECT CAST(vector AS DOUBLE[]) FROM {name} WHERE {_usable_sql(dim)} ORDER BY vec_id LIMIT 1)"
    hits = f"""
    SELECT message_id AS id, s AS score FROM (
      SELECT message_id, vec_id, (1 + list_cosine_similarity(CAST(vector AS DOUBLE[]), {ask})) / 2 AS s FROM {name} WHERE {_usable_sql(dim)} AND {where})
    ORDER BY s DESC, message_id, vec_id LIMIT {size}"""
    inner = f"SELECT id, max(score) AS score FROM ({hits}) GROUP BY id" if collapse else hits
    return f"SELECT id, round(score, 9) AS score FROM ({inner})"


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("id", F.round("score", 9).alias("score"))


def _search(spark: SparkSession, sf_dir: str, name: str, dim: int, size: int, **filters) -> DataFrame:
    v = table(spark, sf_dir, name)
    return _rounded(search.search(v, _first_vector(v, dim), size, tie=("vec_id",), **filters))


def knn_prefilter_chat_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of two chats in a span of time: the filter is applied before the top-k."""
    chats = [r.chat_id for r in table(spark, sf_dir, "chats").orderBy("chat_id").limit(2).collect()]
    return _search(spark, sf_dir, "text_vectors", 384, 200, date_from=datetime(2024, 6, 1), date_to=datetime(2026, 1, 1), chat_ids=chats)


def knn_topk_cap_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "text_vectors")
    return _rounded(search.knn(v, _first_vector(v, 384), 10_000, tie=("vec_id",)))


def knn_image_search_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "image_vectors")
    ask = _first_vector(v, 512)
    size = sum(x * x for x in ask) ** 0.5
    return _rounded(search.search(v, [x / size for x in ask], 100, tie=("vec_id",)))


QUERIES["knn_text_search"] = lambda s, d: _search(s, d, "text_vectors", 384, 100)
ORACLES["knn_text_search"] = _knn_sql("text_vectors", 384, 100)
QUERIES["knn_collapse_max"] = lambda s, d: _search(s, d, "text_vectors", 384, 1000)
ORACLES["knn_collapse_max"] = _knn_sql("text_vectors", 384, 1000)
QUERIES["knn_topk_cap_1000"] = knn_topk_cap_1000
ORACLES["knn_topk_cap_1000"] = _knn_sql("text_vectors", 384, 1000, collapse=False)
QUERIES["knn_prefilter_chat_date"] = knn_prefilter_chat_date
ORACLES["knn_prefilter_chat_date"] = _knn_sql(
    "text_vectors", 384, 200, "date >= TIMESTAMP '2024-06-01' AND date < TIMESTAMP '2026-01-01' AND chat_id IN (SELECT chat_id FROM chats ORDER BY chat_id LIMIT 2)"
)
QUERIES["knn_image_search_normalized"] = knn_image_search_normalized
ORACLES["knn_image_search_normalized"] = _knn_sql("image_vectors", 512, 100)



def knn_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stored index: the nearest lists, then those that may hold something better."""
    v, path = table(spark, sf_dir, "text_vectors"), f"{checkpoint_dir(spark).rstrip('/')}/murmura-index-{uuid.uuid4().hex}"
    index.build(v, path, 384)
    return _rounded(search.collapse(index.search(spark, path, _first_vector(v, 384), 100, tie=("vec_id",))))


QUERIES["knn_index_search"] = knn_index_search
ORACLES["knn_index_search"] = ORACLES["knn_text_search"]


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable vector over its norm, once: the first value and the norm of that."""
    units = table(spark, sf_dir, "image_vectors").where(usable(F.col("vector"), 512)).select("vec_id", l2_normalized(F.col("vector")).alias("unit"))
    return units.select("vec_id", F.round(F.col("unit")[0], 9).alias("first"), F.round(norm(F.col("unit")), 9).alias("norm"))


QUERIES["l2_normalized"] = unit_vectors
_NORM = "sqrt(list_sum(list_transform(CAST(vector AS DOUBLE[]), lambda x: x * x)))"
ORACLES["l2_normalized"] = f"SELECT vec_id, round(CAST(vector[1] AS DOUBLE) / {_NORM}, 9) AS first, 1.0::DOUBLE AS norm FROM image_vectors WHERE {_usable_sql(512)}"

# --- cleaning ---------------------------------------------------------------------------------------------------------


def _without(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, '{pattern.replace('(?iu)', '(?i)')}', '{by}', 'g')"


def _clean_sql(c: str) -> str:
    return _without(_without(_without(_without(c, text.HANDLE), text.IBAN), text.URL), text.ANY_SPACE, " ")


def _length_sql(c: str) -> str:
    kept = ("[^\\p{L}]", "[^\\p{N}]", text.NUMERAL_LETTERS.replace("[", "[^", 1))
    return "CAST(" + " + ".join(f"length(regexp_replace({c}, '{k}', '', 'g'))" for k in kept) + " AS INTEGER)"


def _one(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, "messages").select("id", f(F.col("text")).alias("result"))


for _name, _f, _sql in (
    ("clean_handles", text.remove_handles, _without("text", text.HANDLE)),
    ("clean_iban", lambda c: text.remove_ibans(F.concat(c, F.lit(" DE89 3704 0044 0532 0130 00 Ende"))), _without("(text || ' DE89 3704 0044 0532 0130 00 Ende')", text.IBAN)),
    ("clean_urls", text.remove_urls, _without("text", text.URL)),
    ("collapse_ws", text.collapse_space, _without("text", text.ANY_SPACE, " ")),
    ("clean_text", text.clean, _clean_sql("text")),
    ("alnum_length", text.alnum_length, _length_sql("text")),
):
    QUERIES[_name] = _one(_f)
    ORACLES[_name] = f"SELECT id, {_sql} AS result FROM messages"

_ERROR = "CASE WHEN text_length < 50 THEN 'Text too short' WHEN text_length = 0 THEN 'Text empty after preprocessing' END"


def _preprocessed(source: str) -> str:
    return f"SELECT id, text, text_length, {_ERROR} AS error FROM (SELECT id, text, {_length_sql('text')} AS text_length FROM (SELECT id, {_clean_sql('text')} AS text FROM {source}))"


QUERIES["preprocess_errors"] = lambda s, d: classify.preprocess(table(s, d, "messages").select("id", "text"))
ORACLES["preprocess_errors"] = _preprocessed("messages")
QUERIES["preprocess_error_counts"] = lambda s, d: classify.preprocess(table(s, d, "messages").select("id", "text")).groupBy("error").agg(F.count("*").alias("n"))
ORACLES["preprocess_error_counts"] = f"SELECT error, count(*) AS n FROM ({ORACLES['preprocess_errors']}) GROUP BY error"

# --- scans, filters, counts -------------------------------------------------------------------------------------------

_UNCLASSIFIED = "classification IS NULL AND (text IS NULL) <> (caption IS NULL) AND language IN ('de')"
_AUDIO = "attachment.transcription_status IS NULL AND attachment.type IN ('audio', 'voice')"
_IMAGES = "attachment.type IN ('photo') AND len(list_filter(attachment.storage_refs, lambda r: r.bucket IS NOT NULL OR r.object IS NOT NULL)) > 0"
_EMBED = "(text IS NOT NULL OR caption IS NOT NULL)"


def _scan(condition: Callable, *columns) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, "messages").where(condition()).select(*columns)


def _count(condition: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, "messages").where(condition()).groupBy("chat_id").agg(F.count("*").alias("n"))


for _name, _condition, _sql, _columns in (
    ("unclassified_docs", filters.unclassified, _UNCLASSIFIED, ("id", "text", "caption", "date", "language")),
    ("unprocessed_audio_docs", filters.unprocessed_audio, _AUDIO, ("id", "chat_id", "date", "text")),
    ("messages_to_embed", filters.to_embed, _EMBED, ("id", "chat_id", "date", "language", "text", "caption")),
    ("images_to_vectorize", filters.images, _IMAGES, ("id", "chat_id", "date", "caption")),
):
    QUERIES[_name] = _scan(_condition, *_columns)
    ORACLES[_name] = f"SELECT {', '.join(_columns)} FROM messages WHERE {_sql}"
for _name, _condition, _sql in (("unclassified_count_by_chat", filters.unclassified, _UNCLASSIFIED), ("unprocessed_audio_count", filters.unprocessed_audio, _AUDIO), ("images_to_vectorize_count", filters.images, _IMAGES)):
    QUERIES[_name] = _count(_condition)
    ORACLES[_name] = f"SELECT chat_id, count(*) AS n FROM messages WHERE {_sql} GROUP BY chat_id"


def first_unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of pending messages after a cursor, in order of date: the scan's own limit is the feature."""
    rows = table(spark, sf_dir, "messages").where(filters.unclassified() & filters.after(datetime(2025, 1, 1)))
    return incremental.in_order(rows.select("id", "date").distinct(), 265)


QUERIES["unclassified_page"] = first_unclassified
ORACLES["unclassified_page"] = f"SELECT DISTINCT id, date FROM messages WHERE {_UNCLASSIFIED} AND date > TIMESTAMP '2025-01-01' ORDER BY date, id LIMIT 265"


def message_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = [r.chat_id for r in table(spark, sf_dir, "chats").orderBy(F.desc("chat_id")).limit(5).collect()]
    condition = filters.conjunction(filters.date_range(datetime(2025, 1, 1), datetime(2025, 7, 1)), filters.in_chats(chats))
    return table(spark, sf_dir, "messages").where(condition).select("id", "chat_id", "date")


QUERIES["message_filter"] = message_filter
ORACLES["message_filter"] = "SELECT id, chat_id, date FROM messages WHERE date >= TIMESTAMP '2025-01-01' AND date < TIMESTAMP '2025-07-01' AND chat_id IN (SELECT chat_id FROM chats ORDER BY chat_id DESC LIMIT 5)"
QUERIES["list_chats"] = lambda s, d: vectors.chats(table(s, d, "messages"))
ORACLES["list_chats"] = "SELECT DISTINCT chat_id FROM messages"
QUERIES["tables_from_alias"] = lambda s, d: table(s, d, "chats").select(refs.table_of_chat("messages", F.col("chat_id")).alias("name")).withColumn("chat_id", refs.chat_of_table(F.col("name")))
ORACLES["tables_from_alias"] = "SELECT 'messages_' || chat_id AS name, list_last(string_split('messages_' || chat_id, '_')) AS chat_id FROM chats"
QUERIES["has_attachment_type"] = lambda s, d: filters.attachment_type_by_chat(table(s, d, "messages"), "photo")
ORACLES["has_attachment_type"] = "SELECT chat_id, coalesce(bool_or(attachment.type = 'photo'), FALSE) AS found FROM messages GROUP BY chat_id"

# --- incremental work -------------------------------------------------------------------------------------------------

_MARKS = "(SELECT chat_id, max(date) AS watermark FROM {} GROUP BY chat_id)"
QUERIES["watermark_by_chat"] = lambda s, d: incremental.watermarks(table(s, d, "text_vectors"))
ORACLES["watermark_by_chat"] = "SELECT chat_id, max(date) AS watermark FROM text_vectors GROUP BY chat_id"
QUERIES["pending_after_watermark"] = lambda s, d: incremental.after_watermark(table(s, d, "messages").where(filters.to_embed()), table(s, d, "text_vectors")).select("id", "chat_id", "date")
ORACLES["pending_after_watermark"] = f"""
SELECT id, m.chat_id AS chat_id, date FROM messages m LEFT JOIN {_MARKS.format("text_vectors")} w ON m.chat_id IS NOT DISTINCT FROM w.chat_id
WHERE {_EMBED} AND (watermark IS NULL OR date > watermark)"""
_EXPLODED = """
SELECT id AS message_id, chat_id, language, date, 'text' AS source_field, text AS content FROM messages WHERE text <> ''
UNION ALL SELECT id, chat_id, language, date, 'caption', caption FROM messages WHERE caption <> ''"""
QUERIES["explode_text_fields"] = lambda s, d: embed_text.explode_fields(table(s, d, "messages"))
ORACLES["explode_text_fields"] = _EXPLODED
QUERIES["explode_with_transcription"] = lambda s, d: embed_text.explode_fields(table(s, d, "messages"), ("text", "caption", "attachment.transcription"))
ORACLES["explode_with_transcription"] = _EXPLODED + " UNION ALL SELECT id, chat_id, language, date, 'attachment.transcription', attachment.transcription FROM messages WHERE attachment.transcription <> ''"
QUERIES["pending_anti_join"] = lambda s, d: incremental.without_result(embed_text.explode_fields(table(s, d, "messages")).select("message_id", "source_field"), table(s, d, "text_vectors"), ("message_id", "source_field"))
ORACLES["pending_anti_join"] = f"SELECT message_id, source_field FROM ({_EXPLODED}) e WHERE NOT EXISTS (SELECT 1 FROM text_vectors v WHERE v.message_id = e.message_id AND v.source_field = e.source_field)"
QUERIES["chats_with_new_images"] = lambda s, d: incremental.chats_with_new(table(s, d, "messages"), table(s, d, "image_vectors"), F.col("attachment.type") == "photo")
ORACLES["chats_with_new_images"] = f"""
SELECT m.chat_id AS chat_id, watermark FROM (SELECT chat_id, max(date) AS latest FROM messages WHERE attachment.type = 'photo' GROUP BY chat_id) m
LEFT JOIN {_MARKS.format("image_vectors")} w ON m.chat_id IS NOT DISTINCT FROM w.chat_id WHERE watermark IS NULL OR latest > watermark"""
QUERIES["page_number"] = lambda s, d: incremental.page_numbers(table(s, d, "messages").select("id", "chat_id", "date"), 100).select("id", "chat_id", "page")
ORACLES["page_number"] = "SELECT id, chat_id, CAST(floor((row_number() OVER (PARTITION BY chat_id ORDER BY date NULLS FIRST, id) - 1) / 100) AS BIGINT) AS page FROM messages"

# --- projections ------------------------------------------------------------------------------------------------------

_MEDIA = "list_filter(attachment.storage_refs, lambda r: NOT contains(lower(r.bucket), 'thumbnail'))[1]"
_PATH = f"({_MEDIA}.bucket || '/' || {_MEDIA}.object)"
QUERIES["first_text_field"] = lambda s, d: table(s, d, "messages").select("id", text.first_filled(F.col("text"), F.col("caption")).alias("text"))
ORACLES["first_text_field"] = "SELECT id, coalesce(nullif(text, ''), nullif(caption, '')) AS text FROM messages"
QUERIES["photo_ref"] = lambda s, d: table(s, d, "messages").select("id", refs.photo_object(F.col("attachment.storage_refs")).alias("object"))
ORACLES["photo_ref"] = "SELECT id, list_filter(attachment.storage_refs, lambda r: r.bucket = 'photos')[1].object AS object FROM messages"
QUERIES["media_ref"] = lambda s, d: table(s, d, "messages").select("id", refs.media_path(F.col("attachment.storage_refs")).alias("path"))
ORACLES["media_ref"] = f"SELECT id, {_PATH} AS path FROM messages"
QUERIES["usable_attachments"] = lambda s, d: transcribe.usable(table(s, d, "messages"))
ORACLES["usable_attachments"] = f"SELECT DISTINCT id, {_PATH} AS path FROM messages WHERE id IS NOT NULL AND {_PATH} IS NOT NULL"
QUERIES["media_path_split"] = lambda s, d: transcribe.usable(table(s, d, "messages")).select("id", refs.bucket_of(F.col("path")).alias("bucket"), refs.object_of(F.col("path")).alias("object"), refs.file_name(F.col("path")).alias("file"))
ORACLES["media_path_split"] = f"SELECT id, split_part(path, '/', 1) AS bucket, substr(path, length(split_part(path, '/', 1)) + 2) AS object, list_last(string_split(path, '/')) AS file FROM ({ORACLES['usable_attachments']})"
QUERIES["attachment_type_default"] = lambda s, d: table(s, d, "messages").where("attachment is not null").select("id", refs.attachment_type(F.col("attachment")).alias("attachment_type"))
ORACLES["attachment_type_default"] = "SELECT id, coalesce(nullif(attachment.type, ''), 'photo') AS attachment_type FROM messages WHERE attachment IS NOT NULL"

# --- classification ---------------------------------------------------------------------------------------------------

_PENDING = f"(SELECT DISTINCT id, coalesce(nullif(text, ''), nullif(caption, '')) AS text FROM messages WHERE {_UNCLASSIFIED} AND coalesce(nullif(text, ''), nullif(caption, '')) IS NOT NULL)"
_RESULTS = f"""
SELECT id, error IS NULL AS classified, CASE WHEN error IS NULL THEN CAST(('0x' || substr(md5(text), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE END AS score_pos, error
FROM ({_preprocessed(_PENDING)})"""


def _flat(results: DataFrame) -> DataFrame:
    return results.select("id", *[F.col(f"classification.{c}").alias(c) for c in ("classified", "score_pos", "error")])


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(classify.pending(table(spark, sf_dir, "messages")).dropDuplicates(["id"]))


QUERIES["classify_standin"] = lambda s, d: _flat(_classified(s, d))
ORACLES["classify_standin"] = _RESULTS
QUERIES["classify_positive_tally"] = lambda s, d: models.tally(_flat(_classified(s, d)))
ORACLES["classify_positive_tally"] = f"SELECT count(*) FILTER (score_pos > 0.5) AS positive, count(*) FILTER (score_pos <= 0.5) AS negative FROM ({_RESULTS})"
QUERIES["classify_apply_update"] = lambda s, d: _flat(classify.run(table(s, d, "messages")))
ORACLES["classify_apply_update"] = f"""
SELECT m.id AS id, CASE WHEN r.id IS NULL THEN classification.classified ELSE r.classified END AS classified,
  CASE WHEN r.id IS NULL THEN classification.score_pos ELSE r.score_pos END AS score_pos, CASE WHEN r.id IS NULL THEN classification.error ELSE r.error END AS error
FROM messages m LEFT JOIN ({_RESULTS}) r ON m.id = r.id"""
QUERIES["clear_classification"] = lambda s, d: mutate.clear_classification(table(s, d, "messages")).select("id", "text", *[F.col(f"classification.{c}").alias(c) for c in ("classified", "error")])
ORACLES["clear_classification"] = "SELECT id, text, CAST(NULL AS BOOLEAN) AS classified, CAST(NULL AS VARCHAR) AS error FROM messages"

# --- transcription ----------------------------------------------------------------------------------------------------

_SPEECH = ("transcription", "transcription_status", "transcription_language", "transcription_language_probability")


def _speech(messages: DataFrame) -> DataFrame:
    return messages.select("id", F.col("attachment").isNotNull().alias("has_attachment"), F.col("attachment.type").alias("type"), *[F.col(f"attachment.{f}").alias(f) for f in _SPEECH])


def _speech_sql(case: str) -> str:
    return "SELECT id, attachment IS NOT NULL AS has_attachment, attachment.type AS type, " + ", ".join(case.format(f=f) + f" AS {f}" for f in _SPEECH) + " FROM messages"


QUERIES["clear_transcription"] = lambda s, d: _speech(mutate.clear_fields(table(s, d, "messages")))
ORACLES["clear_transcription"] = _speech_sql("CASE WHEN attachment.transcription_status IS NULL THEN attachment.{f} END")
QUERIES["reset_pending"] = lambda s, d: _speech(mutate.reset_pending(table(s, d, "messages")))
ORACLES["reset_pending"] = _speech_sql("attachment.{f}").replace("attachment.transcription_status AS", "nullif(attachment.transcription_status, 'PENDING') AS")
QUERIES["mark_pending"] = lambda s, d: _speech(transcribe.mark_pending(table(s, d, "messages"), transcribe.open_media(table(s, d, "messages"))))
ORACLES["mark_pending"] = _speech_sql("attachment.{f}").replace(
    "attachment.transcription_status AS", f"CASE WHEN id IN (SELECT id FROM messages WHERE {_AUDIO} AND {_PATH} IS NOT NULL) AND attachment IS NOT NULL THEN 'PENDING' ELSE attachment.transcription_status END AS"
)

QUERIES["transcription_states"] = lambda s, d: table(s, d, "messages").where("attachment is not null").groupBy(F.col("attachment.type").alias("type"), F.col("attachment.transcription_status").alias("status")).agg(F.count("*").alias("n"))
ORACLES["transcription_states"] = "SELECT attachment.type AS type, attachment.transcription_status AS status, count(*) AS n FROM messages WHERE attachment IS NOT NULL GROUP BY 1, 2"


def transcribe_status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of every transcription from its parts: text between blanks, no sound where a type is missing, failed ones."""
    a = F.col("attachment")
    segments = F.when(a["transcription"].isNotNull(), F.array(F.lit(" \t"), a["transcription"], F.lit("\n "))).otherwise(F.array())
    fields = transcribe.outcome(segments, a["transcription_language"], a["transcription_language_probability"], a["type"].isNull(), F.coalesce(a["transcription_status"] == "FAILURE", F.lit(False)))
    return table(spark, sf_dir, "messages").where("attachment is not null").select("id", *fields)


_SPOKEN = f"regexp_replace(' ' || attachment.transcription || ' ', '^{text.ANY_SPACE}|{text.ANY_SPACE}$', '', 'g')"
_HAS_TEXT = "coalesce(attachment.transcription_status, '') <> 'FAILURE' AND attachment.type IS NOT NULL AND attachment.transcription IS NOT NULL"
QUERIES["transcribe_status_machine"] = transcribe_status_machine
ORACLES["transcribe_status_machine"] = f"""
SELECT id, CASE WHEN attachment.transcription_status = 'FAILURE' THEN 'FAILURE' ELSE 'SUCCESS' END AS transcription_status, CASE WHEN {_HAS_TEXT} THEN {_SPOKEN} END AS transcription,
  CASE WHEN {_HAS_TEXT} THEN attachment.transcription_language END AS transcription_language, CASE WHEN {_HAS_TEXT} THEN attachment.transcription_language_probability END AS transcription_language_probability
FROM messages WHERE attachment IS NOT NULL"""

# --- embedding and streams --------------------------------------------------------------------------------------------

_KEYS = f"SELECT DISTINCT message_id, source_field FROM ({_EXPLODED})"


def _places(vectors: DataFrame, *keys: str) -> DataFrame:
    """Of each vector, the places that hold anything and the signs there, in order."""
    signs = F.filter(F.transform("vector", lambda x, i: F.when(x > 0, i + 1).when(x < 0, -i - 1)), lambda x: x.isNotNull())
    return vectors.select(*keys, F.size("vector").alias("dim"), F.array_join(signs, " ").alias("places"))


def _hashed_sql(source: str, keys: str, text: str, dim: int) -> str:
    """The same from the texts: tokens hashed to signed places, by the definition of the stand-in encoder."""
    h = "CAST('0x' || substr(md5(token), 1, 16) AS UBIGINT)"
    tokens = f"SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM {source}"
    summed = f"SELECT {keys}, CAST({h} % {dim} AS BIGINT) AS p, sum(CASE WHEN {h} >= 9223372036854775808 THEN 1 ELSE -1 END) AS n FROM ({tokens}) GROUP BY ALL"
    placed = f"SELECT {keys}, string_agg(CAST(CASE WHEN n > 0 THEN p + 1 ELSE -p - 1 END AS VARCHAR), ' ' ORDER BY p) AS places FROM ({summed}) WHERE n <> 0 GROUP BY ALL"
    return f"SELECT {keys}, {dim} AS dim, coalesce(places, '1') AS places FROM (SELECT {keys} FROM {source}) LEFT JOIN ({placed}) USING ({keys})"


_FIELDS = f"(SELECT DISTINCT ON (message_id, source_field) message_id, source_field, content FROM ({_EXPLODED}))"
QUERIES["embed_text_vectors"] = lambda s, d: _places(embed_text.embed(table(s, d, "messages")), "message_id", "source_field")
ORACLES["embed_text_vectors"] = _hashed_sql(_FIELDS, "message_id, source_field", "content", 384)
QUERIES["embed_then_search"] = lambda s, d: search.search_text(embed_text.embed(table(s, d, "messages")), "Fahrplan der Linie", models.encode_query, 100)


def _stream_dirs(spark: SparkSession) -> tuple[str, str]:
    base = f"{checkpoint_dir(spark).rstrip('/')}/murmura-stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


#: The table of messages as a source of arrivals: a pattern, for it may be a file or a folder.
_ARRIVALS = "messages[.]parquet"


def stream_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages as arrivals of a stream, classified in one run."""
    out, state = _stream_dirs(spark)
    runs.classify_arrivals(spark, f"{sf_dir}/{_ARRIVALS}", out, state)
    return _flat(spark.read.parquet(out))


def stream_embed_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages as arrivals, embedded; a second run over the same arrivals with a new state adds nothing."""
    out, state = _stream_dirs(spark)
    for k in range(2):
        runs.embed_arrivals(spark, f"{sf_dir}/{_ARRIVALS}", out, f"{state}{k}")
    return vectors.read(spark, out, TEXT_VECTORS).select("message_id", "source_field")


QUERIES["stream_classify"] = stream_classify
ORACLES["stream_classify"] = _RESULTS
QUERIES["stream_embed_incremental"] = stream_embed_incremental
ORACLES["stream_embed_incremental"] = _KEYS

# --- media ------------------------------------------------------------------------------------------------------------

#: A stand-in for the store: the content of a file follows from its path (an image begins as a small PNG); names that end in 7 have no file.
_PNG = "89504e470d0a1a0a0000000d49484452000000080000000808020000004b6d29dc"


def _store(paths: DataFrame, image: bool) -> DataFrame:
    content = F.encode("path", "utf-8")
    content = F.concat(F.unhex(F.lit(_PNG)), content) if image else content
    return paths.select("path").distinct().where("path not like '%7' and path not like '%7.%'").select("path", content.alias("content"))


def transcribe_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All open media transcribed by the stand-in, which tells the length of the file; a missing file stays pending."""
    m = table(spark, sf_dir, "messages")
    return _speech(transcribe.run(m, _store(transcribe.usable(m), False)))


_OPEN = f"id IN (SELECT id FROM messages WHERE {_AUDIO} AND {_PATH} IS NOT NULL) AND attachment IS NOT NULL"
_THERE = f"{_PATH} NOT LIKE '%7' AND {_PATH} NOT LIKE '%7.%'"
QUERIES["transcribe_run"] = transcribe_run
ORACLES["transcribe_run"] = f"""
SELECT id, attachment IS NOT NULL AS has_attachment, attachment.type AS type,
  CASE WHEN done THEN 'text of ' || strlen(path) || ' bytes' ELSE attachment.transcription END AS transcription,
  CASE WHEN done THEN 'SUCCESS' WHEN open THEN 'PENDING' ELSE attachment.transcription_status END AS transcription_status,
  CASE WHEN done THEN 'de' ELSE attachment.transcription_language END AS transcription_language,
  CASE WHEN done THEN 0.5 ELSE attachment.transcription_language_probability END AS transcription_language_probability
FROM (SELECT id, attachment, {_PATH} AS path, coalesce({_OPEN}, FALSE) AS open, coalesce({_OPEN} AND {_THERE}, FALSE) AS done FROM messages)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages")
    return embed_images.embed(m, _store(embed_images.pending(m), True))


_PHOTO = "list_filter(attachment.storage_refs, lambda r: r.bucket = 'photos')[1].object"
_PHOTOS = f"(SELECT DISTINCT ON (id) id AS message_id, 'photos/' || {_PHOTO} AS path, coalesce(caption, '') AS caption FROM messages WHERE {_IMAGES} AND {_PHOTO} IS NOT NULL)"
_NO_FILE = "path LIKE '%7' OR path LIKE '%7.%'"
QUERIES["embed_images_run"] = lambda s, d: _places(_images(s, d).where("error is null"), "message_id").unionByName(_images(s, d).where("error is not null").select("message_id", F.lit(0).alias("dim"), F.col("error").alias("places")))
ORACLES["embed_images_run"] = f"""
{_hashed_sql(f"(SELECT message_id, md5(unhex('{_PNG}') || encode(path)) || ' ' || caption AS content FROM {_PHOTOS} WHERE NOT ({_NO_FILE}))", "message_id", "content", 512)}
UNION ALL SELECT message_id, 0 AS dim, 'no file: ' || path AS places FROM {_PHOTOS} WHERE {_NO_FILE}"""


def _joint_sql(query: str) -> str:
    return "[" + ", ".join(str(float(x)) for x in models.encode_query(query, "standin-joint")) + "]::DOUBLE[]"


_ASKED = "Fahrplan der Linie"
QUERIES["image_search_by_text"] = lambda s, d: _rounded(search.search_images(table(s, d, "image_vectors"), _ASKED, lambda q: models.encode_query(q, "standin-joint"), 100, tie=("vec_id",)))
ORACLES["image_search_by_text"] = f"""
SELECT id, round(max(score), 9) AS score FROM (
  SELECT message_id AS id, (1 + list_cosine_similarity(CAST(vector AS DOUBLE[]), {_joint_sql(_ASKED)})) / 2 AS score FROM image_vectors
  WHERE {_usable_sql(512)} ORDER BY score DESC, message_id, vec_id LIMIT 100) GROUP BY id"""


def stream_vectorize_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages as arrivals, their photos vectorized; a second run with a new state adds nothing."""
    out, state = _stream_dirs(spark)
    store = _store(embed_images.pending(table(spark, sf_dir, "messages")), True)
    for k in range(2):
        runs.vectorize_arrivals(spark, f"{sf_dir}/{_ARRIVALS}", store, out, f"{state}{k}")
    return vectors.read(spark, out, IMAGE_VECTORS).select("message_id", F.col("processed_at").isNotNull().alias("dated"))


QUERIES["stream_vectorize_images"] = stream_vectorize_images
ORACLES["stream_vectorize_images"] = f"SELECT message_id, TRUE AS dated FROM {_PHOTOS} WHERE NOT ({_NO_FILE})"
