"""Queries of the shared passages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm.shared_spans import RUN, SharedSpans
from spanwright.operators.snapshot_changes import last_documents
from spanwright.plans import sqltext as Q
from spanwright.plans.anchoring import _LAST
from spanwright.session import read_table


def _spans(spark: SparkSession, sf_dir: str) -> SharedSpans:
    documents = last_documents(read_table(spark, sf_dir, "snapshots"), read_table(spark, sf_dir, "snapshot_docs"))
    return SharedSpans(documents, read_table(spark, sf_dir, "anchors", ["anchor_ord", "doc_key", "span_text"]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the last snapshots, and anchors, that share 150 characters."""
    return _spans(spark, sf_dir).pairs()


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document and anchor lies in other documents too."""
    return _spans(spark, sf_dir).coverage().withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ","))


QUERIES = {"p2_found": p2_found, "p2_coverage": p2_coverage}
# All windows of all texts, without any sketch.
_WINDOWS = f"""WITH {_LAST}, refs AS (
  SELECT DISTINCT doc_key AS ref, doc_key, false AS is_anchor, t FROM docs
  UNION ALL SELECT DISTINCT 'anchor:' || anchor_ord, doc_key, true, {Q.normalize("span_text")} FROM anchors WHERE anchor_ord IS NOT NULL AND span_text IS NOT NULL
), windows AS (
  SELECT DISTINCT ref, doc_key, is_anchor, i::INT AS s, md5_number(substr(t, i + 1, {RUN})) AS w
  FROM (SELECT *, unnest(range(0, length(t) - {RUN} + 1)) AS i FROM refs)
)"""

ORACLES = {
    "p2_found": f"""{_WINDOWS}, held AS (SELECT DISTINCT ref, doc_key, is_anchor, w FROM windows)
SELECT DISTINCT least(a.ref, b.ref) AS ref_a, greatest(a.ref, b.ref) AS ref_b FROM held a JOIN held b ON a.w = b.w AND a.ref <> b.ref
WHERE NOT a.is_anchor AND coalesce(a.doc_key <> b.doc_key, true)""",
    "p2_coverage": f"""{_WINDOWS}, holders AS (SELECT w, min(doc_key) AS lo, max(doc_key) AS hi FROM windows WHERE NOT is_anchor GROUP BY w
), covered AS (
  SELECT DISTINCT ref, s FROM windows JOIN holders USING (w) WHERE doc_key IS NULL OR lo <> doc_key OR hi <> doc_key
), marked AS (SELECT ref, s, coalesce(s > lag(s) OVER (PARTITION BY ref ORDER BY s) + {RUN}, true) AS first FROM covered
), islands AS (SELECT *, sum(first::INT) OVER (PARTITION BY ref ORDER BY s) AS k FROM marked
), spans AS (SELECT ref, k, min(s) AS a, max(s) + {RUN} AS b FROM islands GROUP BY ref, k
), joined AS (SELECT ref, string_agg(a || '-' || b, ',' ORDER BY a) AS spans, sum(b - a)::INT AS covered FROM spans GROUP BY ref
), sizes AS (SELECT ref, bool_or(is_anchor) AS is_anchor, max(length(t))::INT AS n_chars FROM refs GROUP BY ref)
SELECT ref, is_anchor, n_chars, coalesce(spans, '') AS spans, coalesce(covered, 0) AS covered,
  CASE WHEN n_chars > 0 THEN round(coalesce(covered, 0) / n_chars, 6) ELSE 0 END AS share FROM sizes LEFT JOIN joined USING (ref)""",
}
