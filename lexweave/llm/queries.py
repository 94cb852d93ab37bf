"""The registered queries of this subpackage and, where SQL can express one, its DuckDB text.

Each query reads its whole table and returns its full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, licenses, linededup, neardup, packing, pieces, quality, secrets, sharding, toxicity
from .frames import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(read_table(spark, sf_dir, "embeddings"))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op3_chosen_path_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(read_table(spark, sf_dir, "documents"))


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(read_table(spark, sf_dir, "documents"))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.line_frequency_filter(docs).toDF("doc_id", "text", "source", "lines_removed").drop("source")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(read_table(spark, sf_dir, "documents"))


def op7_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).toDF("doc_id", "text", "lines_removed")


def op8_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.feistel_shards(read_table(spark, sf_dir, "documents"))


def op10_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_permutation_index, op2_sum_of_squares_packing, op3_chosen_path_near_dup, op4_merge_dropout, op5_line_frequency, op6_license_scan, op7_line_winnowing, op8_secret_novelty, op9_feistel_shards, op10_fm_toxicity)}

_NORM = r"trim(regexp_replace(lower(raw), '\s+', ' ', 'g'))"

_OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents WHERE text IS NOT NULL),
s AS (SELECT rid, doc_id, text, coalesce(source, chr(1)) AS host, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
l AS (SELECT *, {_NORM} AS norm FROM s),
sizes AS (SELECT coalesce(source, chr(1)) AS host, count(DISTINCT text) AS size FROM d GROUP BY 1),
bad AS (SELECT host, norm FROM l JOIN sizes USING (host) WHERE norm <> '' GROUP BY host, norm, size
        HAVING count(DISTINCT text) > {quality.MAX_DOCS} AND count(DISTINCT text) > {quality.MAX_SHARE} * size),
j AS (SELECT l.*, bad.norm IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.host = bad.host AND l.norm = bad.norm)
SELECT any_value(doc_id) AS doc_id, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS text,
       CAST(count(*) FILTER (gone) AS INTEGER) AS lines_removed
FROM j GROUP BY rid
HAVING coalesce(sum(length(norm)) FILTER (NOT gone), 0) > 0 AND sum(length(norm)) FILTER (NOT gone) >= {quality.MIN_KEEP} * sum(length(norm))
"""


def _feistel_sql() -> str:
    inner = "SELECT r, k, n, lb, rb, v >> rb AS le, v & ((1 << rb) - 1) AS ri FROM walk, q WHERE k = 0 OR v >= n"
    for i, key in enumerate(sharding.round_keys(sharding.KEY)):
        side, other, bits = ("le", "ri", "lb") if i % 2 == 0 else ("ri", "le", "rb")
        inner = f"SELECT *, (xor({other}, {key}) * 1597334677) & {sharding._M31} AS x FROM ({inner})"
        inner = f"SELECT * EXCLUDE (x), (xor(x, x >> 15) * 812015047) & {sharding._M31} AS y FROM ({inner})"
        inner = f"SELECT * REPLACE (xor({side}, xor(y, y >> 13) & ((1 << {bits}) - 1)) AS {side}) FROM ({inner})"
        inner = f"SELECT * EXCLUDE (y) FROM ({inner})"
    return f"""
WITH RECURSIVE q AS (SELECT n, b // 2 AS lb, b - b // 2 AS rb FROM (SELECT count(*) AS n, CAST(greatest(2, length(bin(greatest(count(*) - 1, 1)))) AS BIGINT) AS b FROM documents)),
rows_ AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) - 1 AS r FROM documents),
walk(r, v, k) AS (SELECT r, r, 0 FROM rows_ UNION ALL SELECT r, (le << rb) | ri, k + 1 FROM ({inner}))
SELECT doc_id, w.r AS row_number, v AS position, CAST(v % {sharding.SHARDS} AS INTEGER) AS shard, v // {sharding.SHARDS} AS slot
FROM walk w JOIN rows_ USING (r), q WHERE k > 0 AND v < n
"""


def _license_sql() -> str:
    """Notices by their key phrases alone, which is the same where notices stand in one piece; places are counted by removing the first phrase."""
    parts = []
    for t in licenses.TEMPLATES:
        phrases = [" ".join(licenses.split(p)) for p in t.phrases]
        near = " AND ".join(f"contains(s, ' {p} ')" for p in phrases)
        parts.append(
            f"SELECT doc_id, '{t.name}' AS license, CAST((length(s) - length(replace(s, ' {phrases[0]} ', ' '))) // {len(phrases[0]) + 1} AS INTEGER) AS places, "
            f"CAST(length(substr(s, 1, instr(s, ' {phrases[0]} '))) - length(replace(substr(s, 1, instr(s, ' {phrases[0]} ')), ' ', '')) - 1 AS INTEGER) AS first_word FROM w WHERE {near}"
        )
    alone = r"[\x{3005}-\x{3007}\x{3040}-\x{30ff}\x{3100}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{e00}-\x{eff}\x{20000}-\x{2ffff}]"
    gap = r"[\x00-/:-@\[-`{-\x7f\x{80}-\x{a9}\x{ab}-\x{b4}\x{b6}-\x{b9}\x{bb}-\x{bf}\x{d7}\x{f7}\x{2000}-\x{2bff}\x{3000}-\x{3004}\x{3008}-\x{303f}\x{ff00}-\x{ff0f}\x{ff1a}-\x{ff20}\x{ff3b}-\x{ff40}\x{ff5b}-\x{ff65}]+"
    words = f"' ' || trim(regexp_replace(regexp_replace(lower(text), '({alone})', ' \\1 ', 'g'), '{gap}', ' ', 'g')) || ' '"
    return f"WITH w AS MATERIALIZED (SELECT doc_id, {words} AS s FROM documents WHERE text IS NOT NULL) " + " UNION ALL ".join(parts)


SQL: dict[str, str] = {"op5_line_frequency": _OP5, "op6_license_scan": _license_sql(), "op9_feistel_shards": _feistel_sql()}
