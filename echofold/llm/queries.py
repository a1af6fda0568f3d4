"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from echofold.llm import arrivals, components, leakage, neighbours, packing, quality, spellings, survivors
from echofold.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spellings.found_pairs(table(spark, d, "files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.found_entries(table(spark, d, "envelope_groups"))


def p2_current_values(spark: SparkSession, d: str) -> DataFrame:
    return survivors.current_values(table(spark, d, "envelope_groups"))


def p2_hidden_times(spark: SparkSession, d: str) -> DataFrame:
    return survivors.hidden_times(table(spark, d, "envelope_groups"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.found_pairs(table(spark, d, "clip_embeddings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return arrivals.found(*(table(spark, d, t) for t in ("content_hashes", "audio_fingerprints", "scored_pairs")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.consolidate(table(spark, d, "scored_pairs"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents")), 2048)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.unnatural(table(spark, d, "documents"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_statistics(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_current_values, p2_hidden_times, p3_found, p4_found, p5_found, p6_packed, p7_found, p8_found, p8_statistics)}


P2 = """
WITH m AS (
  SELECT g.group_id, f.path AS path, coalesce(f.is_reference, false) AS ref,
    CASE WHEN f.file_size > 0 THEN f.file_size END AS file_size, CASE WHEN f.bitrate > 0 THEN f.bitrate END AS bitrate,
    CASE WHEN f.mtime > 0 AND NOT isnan(f.mtime) AND NOT coalesce(f.mtime > epoch(TRY_CAST(g.generated_at AS TIMESTAMPTZ)), false) THEN f.mtime END AS mtime
  FROM (SELECT group_id, generated_at, unnest(files) AS f FROM envelope_groups) g WHERE f.path IS NOT NULL),
r AS (SELECT *, (file_size IS NOT NULL)::int + (bitrate IS NOT NULL)::int + (mtime IS NOT NULL)::int AS n FROM m),
e AS (
  SELECT group_id, 'record' AS field_name, path, ref, n, mtime, file_size FROM r
  UNION ALL SELECT group_id, 'file_size', path, ref, n, mtime, file_size FROM r WHERE file_size IS NOT NULL
  UNION ALL SELECT group_id, 'bitrate', path, ref, n, mtime, file_size FROM r WHERE bitrate IS NOT NULL
  UNION ALL SELECT group_id, 'mtime', path, ref, n, mtime, file_size FROM r WHERE mtime IS NOT NULL)
SELECT group_id, field_name, path FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY ref DESC, n DESC, mtime DESC NULLS LAST, file_size DESC NULLS LAST, path) AS k FROM e) WHERE k = 1
"""


P5 = """
WITH RECURSIVE l AS (SELECT DISTINCT path_a AS x, path_b AS y FROM scored_pairs WHERE score >= 70 AND NOT isnan(score) AND path_a <> path_b),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT x AS path, min(y) AS group_path FROM reach GROUP BY x
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2, "p5_found": P5}
