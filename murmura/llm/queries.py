"""Catalogue of the training-data queries: name -> f(spark, directory of the tables), and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm import encode, language, moderation, near, nearest, packing, personal, reading, split
from murmura.sources.tables import cut_lineage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _nearest(spark: SparkSession, sf_dir: str, kind: str, dim: int) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, f"{kind}_vectors"), dim)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which one is among the ten most similar of the other."""
    found = [nearest.pairs(_nearest(spark, sf_dir, kind, dim)).select(F.lit(kind).alias("kind"), "vec_a", "vec_b") for kind, dim in (("text", 384), ("image", 512))]
    return found[0].unionByName(found[1])


QUERIES["p1_found"] = p1_found
QUERIES["p1_nearest_text"] = lambda s, d: _nearest(s, d, "text", 384)
QUERIES["p1_nearest_image"] = lambda s, d: _nearest(s, d, "image", 512)
QUERIES["p2_pieces"] = lambda s, d: split.pieces(split.long_items(table(s, d, "messages")))
QUERIES["p2_found"] = lambda s, d: split.pieces(split.long_items(table(s, d, "messages"))).where("piece_no = 0").select("message_id", "source_field")
ORACLES["p2_found"] = """
SELECT DISTINCT id AS message_id, 'text' AS source_field FROM messages WHERE length(text) > 1200
UNION ALL
SELECT DISTINCT id, 'attachment.transcription' FROM messages WHERE length(attachment.transcription) > 1200
"""


def p2_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every long item put together again from its pieces, and whether they keep the limit and overlap."""
    found = QUERIES["p2_pieces"](spark, sf_dir)
    sorted_pieces = found.groupBy("message_id", "source_field").agg(F.sort_array(F.collect_list(F.struct("piece_no", "start", "end", "piece"))).alias("p"))
    new = F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substr(x["piece"], F.try_element_at("p", i)["end"] - x["start"] + 1)))
    linked = F.forall(F.transform("p", lambda x, i: (i == 0) | ((F.try_element_at("p", i)["end"] - x["start"]).between(1, 200))), lambda ok: F.coalesce(ok, F.lit(True)))
    short = F.forall("p", lambda x: (x["end"] - x["start"]).between(1, split.LIMIT) & (F.length(x["piece"]) == x["end"] - x["start"]))
    return sorted_pieces.select("message_id", "source_field", F.md5(F.array_join(new, "")).alias("item"), linked.alias("linked"), short.alias("short"))


QUERIES["p2_rebuilt"] = p2_rebuilt
ORACLES["p2_rebuilt"] = """
SELECT DISTINCT id AS message_id, 'text' AS source_field, md5(text) AS item, TRUE AS linked, TRUE AS short FROM messages WHERE length(text) > 1200
UNION ALL
SELECT DISTINCT id, 'attachment.transcription', md5(attachment.transcription), TRUE, TRUE FROM messages WHERE length(attachment.transcription) > 1200
"""


def _moderated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.scores(table(spark, sf_dir, "messages"), table(spark, sf_dir, "moderation_labels"))


QUERIES["p3_found"] = lambda s, d: moderation.found(_moderated(s, d))
QUERIES["p3_scores"] = lambda s, d: _moderated(s, d).dropDuplicates(["message_id"])
QUERIES["p3_rates"] = lambda s, d: moderation.rates(_moderated(s, d))
QUERIES["p4_found"] = lambda s, d: language.found(language.segments(table(s, d, "messages")))
QUERIES["p4_labels"] = lambda s, d: language.label(language.segments(table(s, d, "messages")))
QUERIES["p6_found"] = lambda s, d: near.NearDuplicates(near.message_contents(table(s, d, "messages"))).pairs()
QUERIES["p6_links"] = lambda s, d: near.NearDuplicates(near.message_contents(table(s, d, "messages"))).named_links()
QUERIES["p6_groups"] = lambda s, d: near.NearDuplicates(near.message_contents(table(s, d, "messages"))).groups()
QUERIES["p6_classes"] = lambda s, d: near.NearDuplicates(near.message_contents(table(s, d, "messages"))).classes()
_SETS_SQL = r"""
WITH contents AS (SELECT DISTINCT id, CASE WHEN regexp_matches(text, '[^\s\x0B\x1C-\x1F\x{85}\p{Z}]') THEN text ELSE caption END AS content FROM messages WHERE id IS NOT NULL),
words AS (SELECT id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM contents),
shingles AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS g FROM words WHERE len(w) >= 20),
sets AS (SELECT id, count(*) AS n, md5(string_agg(g, ',' ORDER BY g)) AS s FROM shingles GROUP BY id),
met AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT id_a, id_b FROM met JOIN sets a ON a.id = id_a JOIN sets b ON b.id = id_b WHERE 2 * k >= a.n + b.n - k),
classes AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id FROM sets),
links AS (SELECT id_a, id_b FROM pairs JOIN classes a ON a.id = id_a AND a.class_id = id_a JOIN classes b ON b.id = id_b AND b.class_id = id_b)
"""
ORACLES["p6_found"] = _SETS_SQL + "SELECT id_a, id_b FROM pairs"
ORACLES["p6_links"] = _SETS_SQL + "SELECT id_a, id_b FROM links"
ORACLES["p6_classes"] = _SETS_SQL + """
SELECT id, class_id, coalesce(n_links, 0) AS n_links FROM classes
LEFT JOIN (SELECT c, count(*) AS n_links FROM (SELECT id_a AS c FROM links UNION ALL SELECT id_b FROM links) GROUP BY c) ON c = class_id"""
QUERIES["p7_found"] = lambda s, d: personal.entities(table(s, d, "messages")).select("message_id", "source_field", "pii_type", "pii_key").distinct()
QUERIES["p7_redacted"] = lambda s, d: personal.redacted(table(s, d, "messages"))
QUERIES["p8_ids"] = lambda s, d: encode.encode(table(s, d, "documents"))
QUERIES["p9_containers"] = lambda s, d: packing.fill(cut_lineage(encode.sizes(table(s, d, "documents"))))


def p9_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whether its pieces are numbered without gaps, and whether their containers keep the capacity."""
    placed = cut_lineage(QUERIES["p9_containers"](spark, sf_dir))
    load = placed.groupBy("container_id").agg((F.sum("size") <= packing.CAPACITY).alias("fits"))
    pieces = placed.join(load, "container_id").groupBy("doc_id")
    return pieces.agg(F.bool_and("fits").alias("fits"), (F.max("piece_no") + 1 == F.count_distinct("piece_no")).alias("numbered"))


QUERIES["p9_placed"] = p9_placed
ORACLES["p9_placed"] = "SELECT doc_id, TRUE AS fits, TRUE AS numbered FROM documents"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES["p10_found"] = lambda s, d: _levels(s, d).where("reading_level is not null").select("doc_id", "reading_level")
QUERIES["p10_levels"] = _levels
