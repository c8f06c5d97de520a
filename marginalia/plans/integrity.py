"""Problem 1: references without a live entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.operators.orphans import orphan_references, orphan_report, reference_probes
from marginalia.sources.tables import read


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    refs = read(spark, sf, "refs", ["source", "number", "ingested_at", "deleted_at"])
    probes = reference_probes(
        read(spark, sf, "evidence", ["ev_id", "source", "reference_numbers", "created_at"]),
        read(spark, sf, "used_refs", ["use_id", "source", "number", "used_at"]),
    )
    return refs, probes


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references(*_tables(spark, sf)).select("ref_table", "row_id", "ref_number")


def p1_orphans_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(orphan_references(*_tables(spark, sf), keep_live=True))


_SQL = r"""
WITH r AS (
  SELECT DISTINCT regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '\.pdf$', '') AS s, number AS n, ingested_at AS i, deleted_at AS d
  FROM refs WHERE source IS NOT NULL AND number IS NOT NULL
), p AS (
  SELECT DISTINCT 'evidence' AS ref_table, ev_id AS row_id, source, u.n AS ref_number, created_at AS tm
  FROM evidence, unnest(reference_numbers) AS u(n)
  UNION
  SELECT 'used_refs', use_id, source, number, used_at FROM used_refs
), q AS (
  SELECT ref_table, row_id, ref_number, tm, regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '\.pdf$', '') AS s
  FROM p WHERE source IS NOT NULL AND ref_number IS NOT NULL
), k AS (SELECT DISTINCT s, n FROM r WHERE i IS NOT NULL),
live AS (
  SELECT DISTINCT q.ref_table, q.row_id, q.ref_number, q.tm FROM q JOIN r ON r.s = q.s AND r.n = q.ref_number AND r.i <= q.tm AND (r.d IS NULL OR r.d > q.tm)
), f AS (
  SELECT q.*, live.row_id IS NULL AS orphan, k.n IS NULL AS missing
  FROM q LEFT JOIN live ON live.ref_table = q.ref_table AND live.row_id = q.row_id AND live.ref_number = q.ref_number AND live.tm IS NOT DISTINCT FROM q.tm
  LEFT JOIN k ON k.s = q.s AND k.n = q.ref_number
)
"""

QUERIES = {"p1_found": p1_found, "p1_orphans_by_month": p1_orphans_by_month}
ORACLES = {
    "p1_found": _SQL + "SELECT ref_table, row_id, ref_number FROM f WHERE orphan",
    "p1_orphans_by_month": _SQL
    + "SELECT ref_table, strftime(tm, '%Y-%m') AS month, count(*) AS n_refs, count(*) FILTER (WHERE orphan) AS n_orphans, count(*) FILTER (WHERE orphan AND missing) AS n_missing FROM f GROUP BY 1, 2",
}
