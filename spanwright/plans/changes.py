"""Queries over consecutive snapshots."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators.snapshot_changes import snapshot_changes
from spanwright.plans import sqltext
from spanwright.session import read_table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshot_changes(read_table(spark, sf_dir, "snapshots"), read_table(spark, sf_dir, "snapshot_docs"))
    return changes.select("from_snapshot_id", "to_snapshot_id", "doc_key", "change")


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshot_changes(read_table(spark, sf_dir, "snapshots"), read_table(spark, sf_dir, "snapshot_docs"))
    return changes.groupBy("source", "from_snapshot_id", "to_snapshot_id", "change").agg(F.count("*").alias("n_docs"))


_CHANGES_SQL = f"""
WITH headers AS (
  SELECT snapshot_id, (min((captured_at, source)))[1] AS captured_at, (min((captured_at, source)))[2] AS source
  FROM snapshots WHERE snapshot_id IS NOT NULL AND captured_at IS NOT NULL AND source IS NOT NULL GROUP BY snapshot_id
), pairs AS (
  SELECT source, snapshot_id AS from_id,
         lead(snapshot_id) OVER (PARTITION BY source ORDER BY captured_at, snapshot_id) AS to_id
  FROM headers
), texts AS (
  SELECT snapshot_id, doc_key, arg_max(t, (coalesce(delivered_at, '-infinity'::TIMESTAMPTZ), t)) AS t FROM (
    SELECT snapshot_id, doc_key, delivered_at, coalesce('+' || {sqltext.normalize("normalized_text")}, '-') AS t
    FROM snapshot_docs WHERE doc_key IS NOT NULL)
  GROUP BY ALL
), changes AS (
  SELECT p.source, p.from_id AS from_snapshot_id, p.to_id AS to_snapshot_id, b.doc_key,
         CASE WHEN a.doc_key IS NULL THEN 'added' ELSE 'changed' END AS change
  FROM pairs p JOIN texts b ON b.snapshot_id = p.to_id
  LEFT JOIN texts a ON a.snapshot_id = p.from_id AND a.doc_key = b.doc_key
  WHERE a.doc_key IS NULL OR a.t <> b.t
  UNION ALL
  SELECT p.source, p.from_id, p.to_id, a.doc_key, 'removed'
  FROM pairs p JOIN texts a ON a.snapshot_id = p.from_id
  LEFT JOIN texts b ON b.snapshot_id = p.to_id AND b.doc_key = a.doc_key
  WHERE p.to_id IS NOT NULL AND b.doc_key IS NULL
)
"""

QUERIES = {"p4_found": p4_found, "p4_summary": p4_summary}
ORACLES = {
    "p4_found": _CHANGES_SQL + "SELECT from_snapshot_id, to_snapshot_id, doc_key, change FROM changes",
    "p4_summary": _CHANGES_SQL
    + "SELECT source, from_snapshot_id, to_snapshot_id, change, count(*) AS n_docs FROM changes GROUP BY ALL",
}
