"""Queries over texts: normal form, tokens, structure, snapshot ids."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions import text as T
from spanwright.functions.markdown import fenced_regions, parse_headings
from spanwright.operators.snapshot_changes import consecutive
from spanwright.operators.snapshots import incompatible_pairs, snapshot_ids
from spanwright.plans import sqltext as Q
from spanwright.session import read_table


def normalize_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.normalize(F.col("text"))
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select(
        "doc_id", F.char_length(text).alias("n_chars"), T.content_hash(F.col("text")).alias("content_hash")
    )


def technical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", T.technical_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", "|").alias("tokens")).where("n_tokens > 0")


def snapshot_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "snapshot_docs", ["snapshot_id", "doc_key", "normalized_text"])
    return snapshot_ids(docs.select("snapshot_id", "doc_key", T.content_hash(F.col("normalized_text")).alias("content_hash")), ["snapshot_id"])


def incompatible_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = read_table(spark, sf_dir, "snapshots")
    seqs = consecutive(headers)
    a = seqs.select("source", "seq", F.col("snapshot_id").alias("from_snapshot_id"))
    b = seqs.select("source", (F.col("seq") - 1).alias("seq"), F.col("snapshot_id").alias("to_snapshot_id"))
    return incompatible_pairs(headers, a.join(b, ["source", "seq"]).drop("source", "seq"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", T.normalize(F.col("text")).alias("text"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(parse_headings(F.col("text"))).alias("ord", "h"))
    return rows.select("doc_id", "ord", F.array_join("h.path", " > ").alias("path"), "h.level", F.col("h.start").alias("start_at"), F.col("h.end").alias("end_at"))


def fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(fenced_regions(F.col("text"))).alias("r"))
    return rows.select("doc_id", F.col("r.start").alias("start_at"), F.col("r.end").alias("end_at"))


def structure_ctes(texts: str, key: str) -> str:
    """CTEs ``fence_regions`` and ``heads`` (and what they need) over a CTE ``texts`` with ``key`` and normalized ``t``."""
    return f"""
lines AS (
  SELECT {key}, n, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY {key} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos
  FROM (SELECT {key}, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM {texts})
), fence_lines AS (
  SELECT *, substr(mark, 1, 1) AS ch, length(mark) AS len, row_number() OVER (PARTITION BY {key} ORDER BY n) AS k FROM (
    SELECT {key}, n, pos, pos + length(line)::INT AS stop, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})([^\\n]*)$', 1) AS mark,
           {Q.strip("regexp_extract(line, '^ {0,3}(`{3,}|~{3,})([^\\n]*)$', 2)")} AS info FROM lines)
  WHERE mark <> ''
), machine AS (
  SELECT {key}, 0::BIGINT AS k, '' AS och, 0::BIGINT AS olen, 0 AS ostart, NULL::INT AS cstart, NULL::INT AS cstop FROM {texts}
  UNION ALL
  SELECT f.{key}, f.k,
    CASE WHEN m.och = '' AND NOT (f.ch = '`' AND contains(f.info, '`')) THEN f.ch WHEN m.och = f.ch AND f.len >= m.olen AND f.info = '' THEN '' ELSE m.och END,
    CASE WHEN m.och = '' AND NOT (f.ch = '`' AND contains(f.info, '`')) THEN f.len ELSE m.olen END,
    CASE WHEN m.och = '' AND NOT (f.ch = '`' AND contains(f.info, '`')) THEN f.pos ELSE m.ostart END,
    CASE WHEN m.och = f.ch AND f.len >= m.olen AND f.info = '' THEN m.ostart END,
    CASE WHEN m.och = f.ch AND f.len >= m.olen AND f.info = '' THEN f.stop END
  FROM machine m JOIN fence_lines f ON f.{key} = m.{key} AND f.k = m.k + 1
), fence_regions AS (
  SELECT {key}, cstart AS start_at, cstop AS end_at FROM machine WHERE cstart IS NOT NULL
  UNION ALL
  SELECT m.{key}, m.ostart, length(d.t)::INT FROM (SELECT {key}, arg_max(och, k) AS och, arg_max(ostart, k) AS ostart FROM machine GROUP BY {key}) m
  JOIN {texts} d ON d.{key} = m.{key} WHERE m.och <> ''
), head_lines AS (
  SELECT l.{key}, l.pos, l.pos + length(l.line)::INT + 1 AS start_at, length(regexp_extract(l.line, '^(#{{1,6}})(?:[ \\t]+(.+))?$', 1))::INT AS level,
         {Q.strip("regexp_extract(l.line, '^(#{1,6})(?:[ \\t]+(.+))?$', 2)")} AS title
  FROM lines l WHERE regexp_matches(l.line, '^(#{{1,6}})(?:[ \\t]+(.+))?$')
    AND NOT EXISTS (SELECT 1 FROM fence_regions r WHERE r.{key} = l.{key} AND r.start_at <= l.pos AND l.pos < r.end_at)
), numbered AS (
  SELECT h.*, (row_number() OVER (PARTITION BY h.{key} ORDER BY h.pos) - 1)::INT AS ord,
         coalesce(lead(h.pos) OVER (PARTITION BY h.{key} ORDER BY h.pos), length(d.t)::INT) AS end_at
  FROM head_lines h JOIN {texts} d ON d.{key} = h.{key}
), heads AS (
  -- an ancestor has a lesser level than the heading and than all between
  SELECT h.{key}, h.ord, h.level, h.start_at, h.end_at,
    list_concat(coalesce((SELECT list(a.title ORDER BY a.ord) FROM numbered a WHERE a.{key} = h.{key} AND a.ord < h.ord AND a.level < h.level
      AND NOT EXISTS (SELECT 1 FROM numbered b WHERE b.{key} = h.{key} AND b.ord > a.ord AND b.ord < h.ord AND b.level <= a.level)), []), [h.title]) AS path
  FROM numbered h
)"""


_DOCS = f"WITH RECURSIVE texts AS (SELECT doc_id, {Q.normalize('text')} AS t FROM documents WHERE text IS NOT NULL), " + structure_ctes("texts", "doc_id")

QUERIES = {
    "normalize_hash": normalize_hash,
    "technical_tokens": technical_tokens,
    "snapshot_content_ids": snapshot_content_ids,
    "incompatible_snapshots": incompatible_snapshots,
    "parse_headings": headings,
    "fenced_regions": fences,
}
ORACLES = {
    "normalize_hash": f"SELECT doc_id, length({Q.normalize('text')})::INT AS n_chars, sha256({Q.normalize('text')}) AS content_hash FROM documents",
    "technical_tokens": f"""SELECT doc_id, len(t)::INT AS n_tokens, array_to_string(t, '|') AS tokens
FROM (SELECT doc_id, regexp_extract_all({Q.normalize("text")}, '{Q.TECHNICAL_TOKEN}') AS t FROM documents) WHERE len(t) > 0""",
    "snapshot_content_ids": f"""SELECT snapshot_id, sha256('{T.NORMALIZER_VERSION}' || chr(0) || string_agg(doc_key || chr(0) || h || chr(10), '' ORDER BY doc_key)) AS content_id,
  count(*)::INT AS n_documents
FROM (SELECT snapshot_id, doc_key, max(sha256({Q.normalize("normalized_text")})) AS h FROM snapshot_docs
      WHERE doc_key IS NOT NULL AND normalized_text IS NOT NULL GROUP BY ALL) GROUP BY snapshot_id""",
    "incompatible_snapshots": """WITH h AS (SELECT DISTINCT snapshot_id, source, captured_at, normalizer_version, loader_versions FROM snapshots),
p AS (SELECT snapshot_id AS a, lead(snapshot_id) OVER (PARTITION BY source ORDER BY captured_at, snapshot_id) AS b FROM h),
v AS (SELECT snapshot_id, 'normalizer' AS what, normalizer_version AS version FROM h
      UNION ALL SELECT snapshot_id, e.key, e.value FROM (SELECT snapshot_id, unnest(map_entries(loader_versions)) AS e FROM h))
SELECT a AS from_snapshot_id, b AS to_snapshot_id, x.what, x.version AS from_version, y.version AS to_version
FROM p JOIN v x ON x.snapshot_id = a JOIN v y ON y.snapshot_id = b AND y.what = x.what WHERE x.version <> y.version""",
    "parse_headings": _DOCS + " SELECT doc_id, ord, array_to_string(path, ' > ') AS path, level, start_at, end_at FROM heads",
    "fenced_regions": _DOCS + " SELECT doc_id, start_at, end_at FROM fence_regions",
}
