"""Queries of the near-duplicate operator."""

from pyspark.sql import DataFrame, SparkSession

from spanwright.llm.near_duplicates import NearDuplicates
from spanwright.operators.snapshot_changes import last_documents
from spanwright.plans.anchoring import _LAST
from spanwright.session import read_table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_documents(read_table(spark, sf_dir, "snapshots"), read_table(spark, sf_dir, "snapshot_docs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lightly edited copies in the last snapshots."""
    return NearDuplicates(_documents(spark, sf_dir)).pairs()


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of the last snapshots with its class and its number of links."""
    return NearDuplicates(_documents(spark, sf_dir)).groups()


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
# A measure of its own, over all pairs of documents: the share of the word pairs of the longer text, outside of code,
# tables and headings, that stand in the shorter one too.
_PAIRS = f"""WITH RECURSIVE {_LAST}, prose AS (
  SELECT doc_key, regexp_replace(regexp_replace(regexp_replace(t, '(?ms)^ {{0,3}}(```|~~~)[^\\n]*\\n.*?^ {{0,3}}(```|~~~)[`~]*[ \\t]*$', ' ', 'g'),
    '(?m)^[ \\t]*(#{{1,6}}[ \\t][^\\n]*|\\|[^\\n]*)$', ' ', 'g'), '`[^`\\n]*`', ' ', 'g') AS t FROM docs
), words AS (SELECT doc_key, regexp_extract_all(lower(strip_accents(t)), '[\\p{{L}}\\p{{N}}]+') AS w FROM prose
), pairs AS (SELECT DISTINCT doc_key, unnest(list_zip(w[:-2], w[2:])) AS g FROM words
), sizes AS (SELECT doc_key, count(*) AS n FROM pairs GROUP BY 1
), common AS (SELECT a.doc_key AS a, b.doc_key AS b, count(*) AS c FROM pairs a JOIN pairs b ON a.g = b.g AND a.doc_key < b.doc_key GROUP BY ALL
), found AS (SELECT a AS doc_key_a, b AS doc_key_b FROM common JOIN sizes x ON x.doc_key = a JOIN sizes y ON y.doc_key = b WHERE c >= 0.55 * greatest(x.n, y.n))"""
_GROUPS = f"""{_PAIRS}, classes AS (SELECT doc_key, md5(t) AS class FROM docs
), links AS (SELECT DISTINCT x.class AS a, y.class AS b FROM found JOIN classes x ON x.doc_key = doc_key_a JOIN classes y ON y.doc_key = doc_key_b WHERE x.class <> y.class
), ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (SELECT DISTINCT class, class AS r FROM classes UNION SELECT class, b FROM reached JOIN ends ON r = a
), labels AS (SELECT class, min(r) AS least FROM reached GROUP BY class)
SELECT doc_key, least AS "group", class, count(*) OVER (PARTITION BY class) AS n_copies, (SELECT count(*) FROM ends WHERE a = class) AS n_links
FROM classes JOIN labels USING (class)"""

ORACLES = {"p3_found": _PAIRS + " SELECT doc_key_a, doc_key_b FROM found", "p3_groups": _GROUPS}
