"""Queries of the reference-integrity operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.operators.orphans import orphan_report, vault_orphans
from quillmill.runtime import read_table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return vault_orphans(*(read_table(spark, d, t) for t in ("chunks", "file_records", "chunk_vectors", "sync_results")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "period", "chunk_id", "kind")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}

WS_RE2 = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_TRIM = rf"regexp_replace(%s, '^{WS_RE2}|{WS_RE2}$', '', 'g')"

_BASE = f"""
WITH p AS (
  SELECT {_TRIM % 'id'} AS k, min(loaded_at) AS f, max(loaded_at) AS l FROM chunks GROUP BY 1
), d AS (
  SELECT {_TRIM % 'r'} AS k, max(synced_at) AS g
  FROM (SELECT unnest(removed_chunk_ids) AS r, synced_at FROM sync_results) WHERE r IS NOT NULL GROUP BY 1
), refs AS (
  SELECT 'file_records' AS ref_table, {_TRIM % 'c'} AS k, epoch_ms(indexed_at::BIGINT) AS t
  FROM (SELECT unnest(chunk_ids) AS c, indexed_at FROM file_records)
  UNION ALL
  SELECT 'chunk_vectors', {_TRIM % 'chunk_id'}, embedded_at FROM chunk_vectors
), j AS (
  SELECT ref_table, coalesce(strftime(t, '%Y-%m'), 'unknown') AS period, refs.k AS chunk_id,
    CASE WHEN d.k IS NOT NULL AND NOT coalesce(p.l > d.g, false) THEN 'deleted'
         WHEN p.k IS NULL THEN 'missing'
         WHEN t < p.f THEN 'late' END AS kind
  FROM refs LEFT JOIN p ON p.k = refs.k LEFT JOIN d ON d.k = refs.k
  WHERE refs.k <> ''
)
"""
SQL = {
    "p6_found": _BASE + "SELECT DISTINCT ref_table, period, chunk_id, kind FROM j WHERE kind IS NOT NULL",
    "p6_report": _BASE
    + """, g AS (
  SELECT ref_table, period, chunk_id, max(kind) AS kind, count(*) AS n FROM j GROUP BY ALL HAVING max(kind) IS NOT NULL
)
SELECT ref_table, period, kind, count(*) AS n_keys, sum(n)::BIGINT AS n_refs FROM g GROUP BY ALL""",
}
