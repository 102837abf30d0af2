"""Queries over anchors: capturing, finding, resolving, deciding."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions import spans as S
from spanwright.operators import anchors as A
from spanwright.operators.policy import ACTIONS, action_for, needs_human
from spanwright.operators.snapshot_changes import last_documents
from spanwright.plans import sqltext as Q
from spanwright.plans.texts import structure_ctes
from spanwright.session import read_table


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = read_table(spark, sf_dir, "snapshots", ["snapshot_id", "source"]).dropna().groupBy("snapshot_id").agg(F.min("source").alias("source"))
    return read_table(spark, sf_dir, "anchors").join(sources, "snapshot_id", "left")


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.load_documents(last_documents(read_table(spark, sf_dir, "snapshots"), read_table(spark, sf_dir, "snapshot_docs")))


def _resolved(spark: SparkSession, sf_dir: str, rare_token: bool = True) -> tuple[DataFrame, DataFrame]:
    return A.resolve(_anchors(spark, sf_dir), _last(spark, sf_dir), rare_token)


def _flat(resolutions: DataFrame) -> DataFrame:
    return resolutions.select(
        "anchor_ord",
        "resolution",
        F.col("new_char_range.start").alias("new_start"),
        F.col("new_char_range.end").alias("new_end"),
        F.array_join("new_heading_path", " > ").alias("new_path"),
        F.size("candidate_spans").alias("n_candidates"),
        F.md5(F.array_join("candidate_spans", "|").cast("binary")).alias("candidates"),
    )


def resolve_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor against the last snapshot of its source."""
    return _flat(_resolved(spark, sf_dir)[0])


def resolve_anchors_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with every span compared with every document of its source."""
    return _flat(_resolved(spark, sf_dir, rare_token=False)[0])


#: Anchors whose key's MD5 begins so are spoiled where a query is about spoiled ones.
_SPOILED, _UNOWNED = "0", "1"


def _begins(key: str, digit: str):
    return F.startswith(F.md5(F.col(key).cast("string").cast("binary")), F.lit(digit))


def unresolvable_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor resolved after some hashes were spoiled; those that can't be."""
    anchors = _anchors(spark, sf_dir)
    spoiled = anchors.withColumn("span_hash", F.when(_begins("anchor_ord", _SPOILED), F.sha2(F.lit("spoiled").cast("binary"), 256)).otherwise(F.col("span_hash")))
    return A.resolve(spoiled, _last(spark, sf_dir))[1].select("anchor_ord")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.needs_review(_resolved(spark, sf_dir)[0]).select("anchor_ord", "resolution", F.size("candidate_spans").alias("n_candidates"))


def repaired_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repaired(_resolved(spark, sf_dir)[0]).select("anchor_ord", "resolution")


def destroyed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unresolved(_resolved(spark, sf_dir)[0]).select("anchor_ord")


def resolution_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _resolved(spark, sf_dir)[0].groupBy("resolution").agg(F.count("*").alias("n"))
    return counts.withColumn("action", action_for(F.col("resolution"))).withColumn("needs_human", needs_human(F.col("resolution")))


def span_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each anchored span stands in each document of the last snapshot of its source."""
    spans = _anchors(spark, sf_dir).select("source", "span_text").distinct()
    matches = A.span_matches(spans, _last(spark, sf_dir))
    counts = matches.groupBy("source", "span_text", "doc_key").agg(F.count("*").alias("n"), F.min("start").alias("first_start"))
    return counts.select("source", F.md5(F.col("span_text").cast("binary")).alias("span"), "doc_key", "n", "first_start")


def _own_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "snapshot_docs", ["snapshot_id", "doc_key", "normalized_text", "delivered_at"]).where("doc_key IS NOT NULL")
    one = docs.groupBy("snapshot_id", "doc_key").agg(F.max(F.struct("delivered_at", "normalized_text")).alias("d"))
    return A.load_documents(one.select(F.col("snapshot_id").alias("source"), "doc_key", F.col("d.normalized_text").alias("normalized_text")))


def _recaptured(spark: SparkSession, sf_dir: str, spoil: bool = False) -> tuple[DataFrame, DataFrame]:
    requests = read_table(spark, sf_dir, "anchors", ["anchor_ord", "snapshot_id", "doc_key", "span_text"]).distinct()
    if spoil:
        requests = requests.withColumns(
            {
                "span_text": F.when(_begins("anchor_ord", _SPOILED), F.concat("span_text", F.lit(" spoiled"))).otherwise(F.col("span_text")),
                "doc_key": F.when(_begins("anchor_ord", _UNOWNED), F.concat("doc_key", F.lit(" spoiled"))).otherwise(F.col("doc_key")),
            }
        )
    requests = requests.select(
        F.col("anchor_ord").alias("request_id"), F.col("snapshot_id").alias("source"), "doc_key", F.col("span_text").alias("span"), F.lit(0).alias("occurrence")
    )
    return A.capture(requests, _own_documents(spark, sf_dir))


def capture_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anchor's span captured again in the snapshot it comes from."""
    return _recaptured(spark, sf_dir)[0].select(
        F.col("request_id").alias("anchor_ord"),
        F.array_join("heading_path", " > ").alias("path"),
        "span_hash",
        "context_hash",
        F.col("char_range.start").alias("start_at"),
        F.col("char_range.end").alias("end_at"),
    )


def capture_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anchor's span captured again after some spans and documents were spoiled; those that can't be."""
    return _recaptured(spark, sf_dir, spoil=True)[1].select(F.col("request_id").alias("anchor_ord"), "reason")


def heading_paths_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading above each anchor's recorded place, in its own snapshot, and how much of its recorded path that has."""
    anchors = read_table(spark, sf_dir, "anchors", ["anchor_ord", "snapshot_id", "doc_key", "char_range", "heading_path"]).distinct()
    joined = anchors.withColumnRenamed("snapshot_id", "source").join(_own_documents(spark, sf_dir), ["source", "doc_key"])
    path = S.heading_path_at(F.col("headings"), F.col("char_range.start"))
    recorded = F.coalesce("heading_path", F.array().cast("array<string>"))
    return joined.select(
        "anchor_ord", F.array_join(path, " > ").alias("path"), S.common_suffix(path, recorded).alias("common_suffix"), S.paths_resolve(path, recorded).alias("resolves")
    )


_HEADERS = """headers AS (
  SELECT snapshot_id, (min((captured_at, source)))[1] AS captured_at, (min((captured_at, source)))[2] AS source
  FROM snapshots WHERE snapshot_id IS NOT NULL AND captured_at IS NOT NULL AND source IS NOT NULL GROUP BY snapshot_id
)"""
_LAST = f"""{_HEADERS}, last_ids AS (
  SELECT source, snapshot_id FROM headers QUALIFY row_number() OVER (PARTITION BY source ORDER BY captured_at DESC, snapshot_id DESC) = 1
), docs AS (
  SELECT source || chr(1) || doc_key AS id, source, doc_key, {Q.normalize("raw")} AS t FROM (
    SELECT l.source, d.doc_key, (max((coalesce(d.delivered_at, '-infinity'::TIMESTAMPTZ), d.normalized_text)))[2] AS raw
    FROM snapshot_docs d JOIN last_ids l ON l.snapshot_id = d.snapshot_id WHERE d.doc_key IS NOT NULL GROUP BY ALL)
  WHERE raw IS NOT NULL
)"""


def _context(text: str, start: str, stop: str) -> str:
    # nfc_normalize ends at a NUL, so the parts are composed one by one
    before = f"nfc_normalize(substr({text}, greatest({start} - 400, 0) + 1, least({start}, 400)))"
    after = f"nfc_normalize(substr({text}, {stop} + 1, 400))"
    return f"sha256({Q.fold(f'{before} || chr(0) || {after}')})"


_ANCHORS = f"""one_anchor AS (
  SELECT anchor_ord, any_value(source) AS source, any_value(doc_key) AS own_key, coalesce(any_value(heading_path), []) AS own_path,
         any_value({Q.canonical_sha256("span_hash")}) AS span_hash, any_value({Q.canonical_sha256("context_hash")}) AS context_hash,
         any_value(char_range) AS char_range, any_value(span_text) AS span_text
  FROM anchors a LEFT JOIN (SELECT snapshot_id, min(source) AS source FROM snapshots GROUP BY 1) s USING (snapshot_id)
  WHERE anchor_ord IS NOT NULL GROUP BY anchor_ord
), sound AS (
  SELECT * FROM one_anchor WHERE coalesce(sha256({Q.normalize("span_text")}) = span_hash, false)
)"""
_MATCHES = f"""span_docs AS (
  SELECT s.source, s.span_text, d.id, d.doc_key, d.t FROM (SELECT DISTINCT source, span_text FROM SPANS WHERE span_text <> '') s
  JOIN docs d ON d.source = s.source AND contains(d.t, s.span_text)
), matches AS (
  SELECT *, (start_at + length(span_text))::INT AS end_at FROM (
    SELECT *, unnest(list_filter(range(0, length(t) - length(span_text) + 1), lambda i: substr(t, i + 1, length(span_text)) = span_text))::INT AS start_at
    FROM span_docs)
)"""


def _paragraphs(name: str, ranges: str) -> str:
    """CTE of the runs of non-blank lines in ``ranges(anchor_ord, t, lo, hi)``."""
    return f"""{name}_lines AS (
  SELECT *, {Q.strip("line")} = '' AS blank FROM (
    SELECT anchor_ord, t, n, line, lo + coalesce(sum(length(line) + 1) OVER (PARTITION BY anchor_ord ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos
    FROM (SELECT anchor_ord, t, lo, unnest(string_split(substr(t, lo + 1, greatest(hi - lo, 0)), chr(10))) AS line,
                 generate_subscripts(string_split(substr(t, lo + 1, greatest(hi - lo, 0)), chr(10)), 1) AS n FROM {ranges}))
), {name} AS (
  SELECT anchor_ord, any_value(t) AS t, min(pos)::INT AS s, max(pos + length(line))::INT AS e FROM (
    SELECT *, sum(blank::INT) OVER (PARTITION BY anchor_ord ORDER BY n) AS block FROM {name}_lines) WHERE NOT blank GROUP BY anchor_ord, block
)"""


_SUFFIX = "(SELECT coalesce(min(i) - 1, least(len({a}), len({b}))) FROM range(1, least(len({a}), len({b})) + 1) r(i) WHERE {a}[-i] <> {b}[-i])"
_RESOLVE = f"""WITH RECURSIVE {_LAST}, {structure_ctes("docs", "id")}, {_ANCHORS}, {_MATCHES.replace("SPANS", "sound")}, placed AS (
  SELECT m.*, coalesce(h.path, []) AS path, {_context("m.t", "m.start_at", "m.end_at")} AS context
  FROM matches m LEFT JOIN heads h ON h.id = m.id AND h.start_at <= m.start_at AND m.start_at < h.end_at
), owned AS (
  SELECT a.*, p.doc_key, p.start_at, p.end_at, p.path, p.context, NOT coalesce(a.own_key = p.doc_key, false) AS other,
    p.doc_key || ' [' || CASE WHEN array_to_string(p.path, ' > ') = '' THEN '(no heading)' ELSE array_to_string(p.path, ' > ') END || '] @'
      || p.start_at || '-' || p.end_at || ': ' || a.span_text AS place
  FROM sound a JOIN placed p ON p.source = a.source AND p.span_text = a.span_text
), found AS (
  SELECT anchor_ord, count(*) AS n, list(place ORDER BY other, doc_key, start_at) AS places, any_value(other) AS other, any_value(path) AS path,
         any_value(own_path) AS own_path, any_value(start_at) AS start_at, any_value(end_at) AS end_at, any_value(context) AS context,
         any_value(context_hash) AS context_hash, any_value(char_range) AS char_range
  FROM owned GROUP BY anchor_ord
), missing AS (
  SELECT * FROM sound WHERE anchor_ord NOT IN (SELECT anchor_ord FROM found)
), scored AS (
  SELECT a.anchor_ord, d.doc_key, d.t, h.ord, h.start_at, h.end_at, coalesce(a.own_key = d.doc_key, false) AS own,
    CASE WHEN h.path = a.own_path THEN 1000000 ELSE {_SUFFIX.format(a="h.path", b="a.own_path")} END AS score
  FROM missing a JOIN docs d ON d.source = a.source JOIN heads h ON h.id = d.id AND h.path[-1] = a.own_path[-1]
  WHERE len(a.own_path) > 0
), heading AS (
  SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY anchor_ord ORDER BY own DESC, doc_key, score DESC, ord) = 1
), chosen AS (
  SELECT a.anchor_ord, a.context_hash, a.own_path, h.start_at AS lo, h.end_at AS hi, coalesce(h.t, d.t) AS t
  FROM missing a LEFT JOIN heading h ON h.anchor_ord = a.anchor_ord LEFT JOIN docs d ON d.source = a.source AND d.doc_key = a.own_key
), under_ranges AS (SELECT anchor_ord, t, lo, hi FROM chosen WHERE lo IS NOT NULL
), {_paragraphs("under", "under_ranges")}, whole_ranges AS (
  SELECT anchor_ord, t, 0 AS lo, length(t)::INT AS hi FROM chosen WHERE t IS NOT NULL AND anchor_ord NOT IN (SELECT anchor_ord FROM under)
), {_paragraphs("whole", "whole_ranges")}, candidates AS (
  SELECT u.anchor_ord, substr(u.t, s + 1, e - s) AS txt, s, coalesce({_context("u.t", "s", "e")} = c.context_hash, false) AS fits, true AS under
  FROM under u JOIN chosen c USING (anchor_ord)
  UNION ALL
  SELECT w.anchor_ord, substr(w.t, s + 1, e - s), s, true, false FROM whole w JOIN chosen c USING (anchor_ord) WHERE {_context("w.t", "s", "e")} = c.context_hash
), suggestion AS (
  SELECT anchor_ord, arg_min(txt, s) AS txt FROM candidates WHERE fits GROUP BY anchor_ord
), listed AS (
  SELECT c.anchor_ord, CASE WHEN any_value(g.txt) IS NULL THEN list(c.txt ORDER BY c.s)
    ELSE list_concat([any_value(g.txt)], coalesce(list(c.txt ORDER BY c.s) FILTER (WHERE c.txt <> g.txt), [])) END AS spans
  FROM candidates c LEFT JOIN suggestion g USING (anchor_ord) GROUP BY c.anchor_ord
), resolved AS (
  SELECT anchor_ord,
    CASE WHEN n > 1 THEN 'ambiguous'
      WHEN other OR NOT ((len(own_path) = 0 AND len(path) = 0) OR (len(own_path) > 0 AND len(path) > 0 AND own_path[-1] = path[-1])) THEN 'valid_relocated'
      WHEN coalesce(start_at = char_range['start'] AND context = context_hash, false) THEN 'valid' ELSE 'valid_repaired' END AS resolution,
    CASE WHEN n = 1 THEN start_at END AS new_start, CASE WHEN n = 1 THEN end_at END AS new_end,
    CASE WHEN n = 1 THEN path END AS new_path, CASE WHEN n > 1 THEN places ELSE [] END AS spans
  FROM found
  UNION ALL
  SELECT c.anchor_ord, CASE WHEN l.spans IS NULL THEN 'destroyed' ELSE 'stale' END, NULL, NULL, CASE WHEN l.spans IS NOT NULL THEN c.own_path END, coalesce(l.spans, [])
  FROM chosen c LEFT JOIN listed l USING (anchor_ord)
)
"""
_FLAT = """SELECT anchor_ord, resolution, new_start, new_end, array_to_string(new_path, ' > ') AS new_path, len(spans)::INT AS n_candidates,
  md5(array_to_string(spans, '|')) AS candidates FROM resolved"""
_ACTION = "CASE resolution " + " ".join(f"WHEN '{r}' THEN '{a}'" for r, a in ACTIONS.items()) + " END"

_OWN = f"""WITH RECURSIVE own_docs AS (
  SELECT snapshot_id || chr(1) || doc_key AS id, snapshot_id, doc_key, {Q.normalize("raw")} AS t FROM (
    SELECT snapshot_id, doc_key, (max((coalesce(delivered_at, '-infinity'::TIMESTAMPTZ), normalized_text)))[2] AS raw
    FROM snapshot_docs WHERE doc_key IS NOT NULL GROUP BY ALL) WHERE raw IS NOT NULL
), asked AS (SELECT DISTINCT anchor_ord, snapshot_id, doc_key, span_text FROM anchors
), used AS (SELECT * FROM own_docs SEMI JOIN asked USING (snapshot_id, doc_key)
), {structure_ctes("used", "id")}, spot AS (
  SELECT a.*, d.id, d.t, {Q.normalize("a.span_text")} AS span, strpos(d.t, {Q.normalize("a.span_text")})::INT - 1 AS s
  FROM asked a LEFT JOIN used d USING (snapshot_id, doc_key)
)"""

QUERIES = {
    "resolve_anchors": resolve_anchors,
    "resolve_anchors_nested": resolve_anchors_nested,
    "unresolvable_anchors": unresolvable_anchors,
    "review_queue": review_queue,
    "repaired_anchors": repaired_anchors,
    "destroyed_anchors": destroyed_anchors,
    "resolution_actions": resolution_actions,
    "span_occurrences": span_occurrences,
    "capture_anchors": capture_anchors,
    "capture_rejects": capture_rejects,
    "heading_paths_at": heading_paths_at,
}
ORACLES = {
    "resolve_anchors": _RESOLVE + _FLAT,
    "resolve_anchors_nested": _RESOLVE + _FLAT,
    "unresolvable_anchors": f"""WITH {_ANCHORS} SELECT anchor_ord FROM one_anchor
WHERE md5(anchor_ord::VARCHAR) LIKE '{_SPOILED}%' OR anchor_ord NOT IN (SELECT anchor_ord FROM sound)""",
    "review_queue": _RESOLVE + "SELECT anchor_ord, resolution, len(spans)::INT AS n_candidates FROM resolved WHERE resolution IN ('stale', 'ambiguous')",
    "repaired_anchors": _RESOLVE + "SELECT anchor_ord, resolution FROM resolved WHERE resolution IN ('valid_repaired', 'valid_relocated')",
    "destroyed_anchors": _RESOLVE + "SELECT anchor_ord FROM resolved WHERE resolution = 'destroyed'",
    "resolution_actions": _RESOLVE
    + f"SELECT resolution, count(*) AS n, {_ACTION} AS action, resolution IN ('stale', 'ambiguous') AS needs_human FROM resolved GROUP BY resolution",
    "span_occurrences": f"""WITH {_LAST}, every_span AS (
  SELECT DISTINCT s.source, a.span_text FROM anchors a JOIN (SELECT snapshot_id, min(source) AS source FROM snapshots GROUP BY 1) s USING (snapshot_id)
), {_MATCHES.replace("SPANS", "every_span")}
SELECT source, md5(span_text) AS span, doc_key, count(*) AS n, min(start_at) AS first_start FROM matches GROUP BY source, span_text, doc_key""",
    "capture_anchors": _OWN
    + f""" SELECT spot.anchor_ord, coalesce(array_to_string(h.path, ' > '), '') AS path, sha256({Q.normalize("span")}) AS span_hash,
  {_context("t", "s", "(s + length(span))")} AS context_hash, s AS start_at, (s + length(span))::INT AS end_at
FROM spot LEFT JOIN heads h ON h.id = spot.id AND h.start_at <= spot.s AND spot.s < h.end_at WHERE spot.s >= 0 AND span <> ''""",
    "capture_rejects": _OWN.replace(
        "asked AS (SELECT DISTINCT anchor_ord, snapshot_id, doc_key, span_text FROM anchors",
        f"""asked AS (SELECT DISTINCT anchor_ord, snapshot_id, CASE WHEN md5(anchor_ord::VARCHAR) LIKE '{_UNOWNED}%' THEN doc_key || ' spoiled' ELSE doc_key END AS doc_key,
  CASE WHEN md5(anchor_ord::VARCHAR) LIKE '{_SPOILED}%' THEN span_text || ' spoiled' ELSE span_text END AS span_text FROM anchors""",
    )
    + """ SELECT anchor_ord, CASE WHEN t IS NULL THEN 'no such document' ELSE 'span not found' END AS reason FROM spot
WHERE t IS NULL OR span IS NULL OR span = '' OR s < 0""",
    "heading_paths_at": _OWN
    + f""", q AS (
  SELECT DISTINCT a.anchor_ord, a.snapshot_id || chr(1) || a.doc_key AS id, a.char_range['start'] AS s, coalesce(a.heading_path, []) AS recorded FROM anchors a
), p AS (
  SELECT q.anchor_ord, q.recorded, coalesce(h.path, []) AS path FROM q JOIN used u ON u.id = q.id
  LEFT JOIN heads h ON h.id = q.id AND h.start_at <= q.s AND q.s < h.end_at
)
SELECT anchor_ord, array_to_string(path, ' > ') AS path, {_SUFFIX.format(a="path", b="recorded")}::INT AS common_suffix,
  (len(path) = 0 AND len(recorded) = 0) OR (len(path) > 0 AND len(recorded) > 0 AND path[-1] = recorded[-1]) AS resolves FROM p""",
}
