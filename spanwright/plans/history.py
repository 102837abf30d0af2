"""Queries over loaded documents, differences of snapshots, and the study run on the snapshots."""

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.markdown import LOADER, LOADER_VERSION
from spanwright.functions.text import NORMALIZER_VERSION, canonical_label, canonical_sha256, content_hash
from spanwright.operators import anchors as A
from spanwright.operators import study_run as R
from spanwright.operators.observations import distinct_observations
from spanwright.operators.snapshot_changes import consecutive
from spanwright.operators.snapshots import build_diff, build_snapshot, diff_documents, load_markdown
from spanwright.operators.study import quarter_of
from spanwright.plans import sqltext as Q
from spanwright.plans.anchoring import _ANCHORS, _FLAT, _HEADERS, _RESOLVE, _anchors, _flat, _last, _own_documents
from spanwright.plans.study import _OBS, SEED
from spanwright.plans.texts import structure_ctes
from spanwright.session import materialize, read_table

_AT = datetime(2025, 1, 1, tzinfo=UTC)


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_table(spark, sf_dir, "documents", ["doc_key", "text"]).where("doc_key IS NOT NULL AND text IS NOT NULL")
    return load_markdown(raw.groupBy("doc_key").agg(F.max("text").alias("raw")))


def loaded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a loader hands it on; of a key's texts the greatest."""
    return _loaded(spark, sf_dir).select("doc_key", "source_path", "content_hash", F.size("headings").alias("n_headings"), "loader", "loader_version")


def built_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of a snapshot of the corpus."""
    header, documents = build_snapshot(materialize(_loaded(spark, sf_dir), "loaded"), "corpus", _AT)
    counted = documents.agg(F.count("*").alias("n_documents"))
    return header.select("snapshot_id", "source", "normalizer_version", F.to_json("loader_versions").alias("loader_versions")).join(counted)


def _texts_of(spark: SparkSession, sf_dir: str, back: int) -> DataFrame:
    """Documents of each source's newest snapshot, or the one ``back`` before."""
    ids = consecutive(read_table(spark, sf_dir, "snapshots")).where(F.col("n_snapshots") - F.col("seq") == back).select("snapshot_id", "source")
    docs = read_table(spark, sf_dir, "snapshot_docs", ["snapshot_id", "doc_key", "normalized_text", "delivered_at"]).where("doc_key IS NOT NULL").join(ids, "snapshot_id")
    one = docs.groupBy("source", "doc_key").agg(F.max(F.struct("delivered_at", "normalized_text"))["normalized_text"].alias("t"))
    return one.select("source", "doc_key", F.col("t").alias("normalized_text"), content_hash(F.col("t")).alias("content_hash"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the newest snapshots changed against those before; a key belongs to one source."""
    return diff_documents(_texts_of(spark, sf_dir, 1), _texts_of(spark, sf_dir, 0))


def _diff(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The last two snapshots of the first source, and its anchors."""
    headers = read_table(spark, sf_dir, "snapshots")
    source = headers.agg(F.min("source")).first()[0]
    seqs = consecutive(headers).where((F.col("source") == source) & (F.col("n_snapshots") - F.col("seq") < 2))
    named = headers.dropDuplicates(["snapshot_id"]).join(seqs.select("snapshot_id", (F.col("n_snapshots") - F.col("seq")).alias("back")), "snapshot_id")
    before, after = (_texts_of(spark, sf_dir, back).where(F.col("source") == source) for back in (1, 0))
    after = A.load_documents(after).select("doc_key", F.col("text").alias("normalized_text"), "headings", content_hash(F.col("text")).alias("content_hash"))
    anchors = _anchors(spark, sf_dir).where(F.col("source") == source)
    return build_diff(named.where("back = 1"), before, named.where("back = 0"), after, anchors, _AT)


def diff_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)[0].select("doc_key", "change")


def diff_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_diff(spark, sf_dir)[1])


def resolve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchors whose text has their hash, resolved in their order; any other would raise."""
    anchors = _anchors(spark, sf_dir)
    bad = A.distinct_anchors(anchors).where(~F.coalesce(content_hash(F.col("span_text")) == F.col("span_hash"), F.lit(False))).select("anchor_ord")
    return _flat(A.resolve_all(anchors.join(bad, "anchor_ord", "left_anti"), _last(spark, sf_dir)))


def observations_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their anchor's document and stratum, which single deliveries may lack."""
    rows = read_table(spark, sf_dir, "observations")
    about = rows.select("cohort", canonical_sha256(F.col("span_hash")).alias("span_hash"), "doc_key", canonical_label(F.col("stratum")).alias("stratum")).dropna(subset=["cohort", "span_hash"])
    seen = distinct_observations(rows).select("cohort", "span_hash", "offset_days", "resolution")
    return R.with_anchor_metadata(seen, about)


def _cohorts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All snapshots as ``headers``, and those with a later one of their source as cohorts, numbered by time."""
    rows = read_table(spark, sf_dir, "snapshots", ["snapshot_id", "source", "captured_at"]).dropna()
    headers = rows.groupBy("snapshot_id").agg(F.min(F.struct("captured_at", "source")).alias("h")).select("snapshot_id", "h.*")
    seqs = consecutive(rows).where("seq < n_snapshots").select("snapshot_id")
    earlier = headers.select(F.struct("captured_at", "snapshot_id").alias("other"))
    base = headers.join(seqs, "snapshot_id")
    # headers are few
    ranks = base.join(earlier, F.col("other") <= F.struct("captured_at", "snapshot_id")).groupBy("snapshot_id").agg(F.count("*").cast("int").alias("cohort"))
    return base.join(ranks, "snapshot_id"), headers


def study_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors drawn in every snapshot that has a later one."""
    cohorts, _ = _cohorts(spark, sf_dir)
    drawn = R.draw_anchors(cohorts, _own_documents(spark, sf_dir).withColumnRenamed("source", "snapshot_id"), SEED)
    return drawn.select("cohort", "doc_key", "span_hash", F.col("char_range.start").alias("start_at"), "stratum")


def study_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study on the snapshots: anchors drawn in each, observed in the later ones at the reachable horizons."""
    cohorts, headers = _cohorts(spark, sf_dir)
    documents = materialize(_own_documents(spark, sf_dir).withColumnRenamed("source", "snapshot_id"), "snapshot-documents")
    anchors = materialize(R.draw_anchors(cohorts, documents, SEED), "drawn")
    # where no newer snapshot came before the horizon there is nothing to compare with
    asked = materialize(R.targets(cohorts, headers).where("snapshot_id <> observed_id"), "targets")
    observations, _ = R.observe(anchors, asked, documents)
    quarters = cohorts.select("cohort", quarter_of(F.col("captured_at")).alias("quarter"))
    return observations.join(quarters, "cohort")


QUERIES = {
    f.__name__: f
    for f in (loaded_documents, built_snapshot, snapshot_diff, diff_changes, diff_resolutions, resolve_all, observations_with_metadata, study_anchors, study_observations)
}

_LOADED = f"""loaded AS (SELECT doc_key, {Q.normalize("raw")} AS t FROM (SELECT doc_key, max(text) AS raw FROM documents WHERE doc_key IS NOT NULL AND text IS NOT NULL GROUP BY 1))"""
_FIRST = "(SELECT min(source) FROM snapshots)"


def _diff_sql(where: str = "true") -> str:
    return f"""WITH {_HEADERS}, ids AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY captured_at DESC, snapshot_id DESC) AS back FROM headers
), texts AS (
  SELECT i.back, d.doc_key, (max((coalesce(d.delivered_at, '-infinity'::TIMESTAMPTZ), d.normalized_text)))[2] AS raw
  FROM snapshot_docs d JOIN ids i USING (snapshot_id) WHERE d.doc_key IS NOT NULL AND i.back <= 2 AND {where} GROUP BY ALL
), hashed AS (SELECT back, doc_key, sha256({Q.normalize("raw")}) AS h FROM texts)
SELECT coalesce(a.doc_key, b.doc_key) AS doc_key, CASE WHEN a.doc_key IS NULL THEN 'added' WHEN b.doc_key IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM hashed WHERE back = 2) a FULL JOIN (SELECT * FROM hashed WHERE back = 1) b ON a.doc_key = b.doc_key
WHERE a.doc_key IS NULL OR b.doc_key IS NULL OR a.h IS DISTINCT FROM b.h"""


ORACLES = {
    "loaded_documents": f"""WITH RECURSIVE {_LOADED}, {structure_ctes("loaded", "doc_key")}
SELECT l.doc_key, l.doc_key AS source_path, sha256(t) AS content_hash, (SELECT count(*) FROM heads h WHERE h.doc_key = l.doc_key)::INT AS n_headings,
  '{LOADER}' AS loader, '{LOADER_VERSION}' AS loader_version FROM loaded l""",
    "built_snapshot": f"""WITH {_LOADED}
SELECT sha256('{NORMALIZER_VERSION}' || chr(0) || string_agg(doc_key || chr(0) || sha256(t) || chr(10), '' ORDER BY doc_key)) AS snapshot_id, 'corpus' AS source,
  '{NORMALIZER_VERSION}' AS normalizer_version, '{{"{LOADER}":"{LOADER_VERSION}"}}' AS loader_versions, count(*) AS n_documents FROM loaded""",
    "snapshot_diff": _diff_sql(),
    "diff_changes": _diff_sql(f"i.source = {_FIRST}"),
    "diff_resolutions": _RESOLVE + _FLAT + f" WHERE anchor_ord IN (SELECT anchor_ord FROM one_anchor WHERE source = {_FIRST})",
    "resolve_all": _RESOLVE + _FLAT,
    "observations_with_metadata": f"""WITH {_OBS}, about AS (
  SELECT cohort, {Q.canonical_sha256("span_hash")} AS span_hash, max(doc_key) AS doc_key, max({Q.canonical_label("stratum")}) AS stratum FROM observations GROUP BY 1, 2)
SELECT o.cohort, o.span_hash, o.offset_days, o.resolution, a.doc_key, a.stratum FROM obs o JOIN about a ON a.cohort = o.cohort AND a.span_hash = o.span_hash""",
}
