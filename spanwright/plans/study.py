"""Queries of the study: sampling, observing, survival, and checks of questions and runs."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright.operators import grounding as G
from spanwright.operators import study as K
from spanwright.operators.observations import distinct_observations
from spanwright.operators.policy import may_retire, retirement
from spanwright.plans import sqltext as Q
from spanwright.plans.anchoring import _LAST, _last
from spanwright.plans.texts import structure_ctes
from spanwright.session import read_table

SEED = "study"
ANALYSIS_DATE = "2026-03-20"
KEY = ["cohort", "span_hash"]


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_observations(read_table(spark, sf_dir, "observations"))


def observations_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir)


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = read_table(spark, sf_dir, "anchors", ["span_text"]).distinct()
    return spans.groupBy(K.stratum(F.col("span_text")).alias("stratum")).agg(F.count("*").alias("n_spans"))


def auto_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["source", "text"])
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(K.is_auto_generated(F.col("text"))).alias("n_generated"))


def eligible_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the last snapshots that an anchor may be drawn from."""
    spans = _last(spark, sf_dir).select("doc_key", F.explode(K.eligible_spans(F.col("text"))).alias("s"))
    return spans.select("doc_key", F.md5(F.col("s.span").cast("binary")).alias("span"), F.col("s.start").alias("start_at"), K.stratum(F.col("s.span")).alias("stratum"))


def eligible_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _last(spark, sf_dir).select("source", F.size(K.eligible_spans(F.col("text"))).alias("n")).where("n > 0")
    return K.upper_medians(counts, ["source"], "n").select("source", F.col("median").alias("median_spans"))


def quarter_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order of each quarter, drawn by hash, as a commit would be."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"]).withColumn("quarter", K.quarter_of(F.col("o_orderdate")))
    return K.draw(orders, ["quarter"], "o_orderkey", 1, SEED).select("quarter", "o_orderkey")


def commits_per_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = K.quarter_of(F.col("o_orderdate")).alias("quarter")
    return read_table(spark, sf_dir, "orders", ["o_orderdate"]).groupBy(quarter).agg(F.count("*").alias("n"))


def drawn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents of each source."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "source"]).distinct()
    return K.draw(docs, ["source"], "doc_id", 50, SEED)


def churn_90d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.trailing_counts(read_table(spark, sf_dir, "orders", ["o_orderdate"]), "o_orderdate")


def asof_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cohort's date, moved into the years of the orders, the newest order up to then."""
    dates = read_table(spark, sf_dir, "observations", ["cohort", "cohort_date"]).dropna().distinct()
    asked = dates.withColumn("asked_at", F.to_timestamp(F.add_months(F.to_date("cohort_date"), -12 * 27)))
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    out = K.as_of(asked, "asked_at", orders, "o_orderdate", "o_orderkey")
    return out.select("cohort", F.date_format("asked_at", "yyyy-MM-dd").alias("asked_on"), "o_orderkey")


def reachable_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohorts = read_table(spark, sf_dir, "observations", ["cohort", "cohort_date"]).dropna().distinct()
    return K.reachable_horizons(cohorts, ANALYSIS_DATE).withColumn("censored", F.round("censored", 9))


def _first(spark: SparkSession, sf_dir: str, event: str = "stale") -> DataFrame:
    return K.first_events(_observations(spark, sf_dir), event)


def first_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir)


def distinct_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir).agg(F.count_distinct(*KEY).alias("n_anchors"))


def _curve(spark: SparkSession, sf_dir: str, event: str, by: list[str]) -> DataFrame:
    return K.kaplan_meier(_first(spark, sf_dir, event), by).withColumn("survival", F.round("survival", 9))


def kaplan_meier_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir, "stale", [])


def kaplan_meier_destroyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir, "destroyed", [])


def kaplan_meier_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir, "stale", ["stratum"])


def kaplan_meier_by_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = K.churn_split(_first(spark, sf_dir))
    return K.kaplan_meier(split, ["churn"]).withColumn("survival", F.round("survival", 9))


def survival_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each stratum the anchors, events, median and survival at the horizons."""
    first = _first(spark, sf_dir).where("stratum IS NOT NULL")
    curve = K.kaplan_meier(first, ["stratum"])
    at = K.survival_at(curve, first, ["stratum"])
    n = first.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("event").alias("n_events"))
    medians = n.join(K.median_survival(curve, ["stratum"]), "stratum", "left")
    return at.join(medians, "stratum").select("stratum", "n", "n_events", "median", "horizon", F.round("survival", 9).alias("survival"))


def resolution_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.resolution_histogram(_observations(spark, sf_dir)).withColumn("percent", F.round("percent", 9))


def destroyed_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.destroyed_recovery(_observations(spark, sf_dir))


def _retirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _observations(spark, sf_dir)
    at = F.to_timestamp(F.date_add(F.to_date("cohort_date"), F.col("offset_days")))
    return retirement(seen.select(*KEY, F.col("offset_days").alias("seq"), at.alias("observed_at"), "resolution"), KEY)


def retirement_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retirement(spark, sf_dir).where("n_run > 0").withColumn("elapsed_days", F.round("elapsed_days", 6))


def retirements_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who may be retired if every anchor of an even cohort is confirmed."""
    confirmed = F.when(F.col("cohort") % 2 == 0, "someone").otherwise("")
    return may_retire(_retirement(spark, sf_dir), confirmed).groupBy("propose", "may_retire").agg(F.count("*").alias("n"))


def tokens_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each candidate's quote stands in its anchor, and the technical tokens of its question that don't."""
    checked = G.grounding(read_table(spark, sf_dir, "candidates"), read_table(spark, sf_dir, "anchors", ["anchor_ord", "span_text"]))
    return checked.select("candidate_id", "grounded", F.array_join("missing", "|").alias("missing"))


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucket of each candidate after the checks that need no judgement."""
    return G.triage(read_table(spark, sf_dir, "candidates"), read_table(spark, sf_dir, "anchors", ["anchor_ord", "span_text"]))


def dataset_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dataset_hash(read_table(spark, sf_dir, "test_cases", ["benchmark_id", "test_id", "question"]), ["benchmark_id"])


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A run made up of the data: each test finds what the next tests of its benchmark expect, in a rotated order."""
    rows = read_table(spark, sf_dir, "test_cases", ["benchmark_id", "test_id", "expected_doc_key"]).where("test_id IS NOT NULL")
    tests = rows.groupBy("test_id").agg(F.max("benchmark_id").alias("benchmark_id"), F.max("expected_doc_key").alias("expected_doc_key"))
    tests = tests.withColumn("k", F.row_number().over(Window.partitionBy("benchmark_id").orderBy("test_id")))
    near = tests.select("test_id", "benchmark_id", "k", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("d")).withColumn("other", F.col("k") + F.col("d"))
    found = near.join(tests.select("benchmark_id", F.col("k").alias("other"), F.col("expected_doc_key").alias("doc_key")), ["benchmark_id", "other"])
    rank = ((F.col("d") + F.col("k") % 7) % 10 + 1).alias("rank")
    return found.select("benchmark_id", "test_id", rank, "doc_key", (F.col("k") * 1.5).alias("latency_ms")), tests


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, tests = _hits(spark, sf_dir)
    metrics = G.retrieval_metrics(hits, tests, ["benchmark_id"])
    return metrics.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in metrics.dtypes))


_OBS = f"""obs AS (
  SELECT cohort, span_hash, offset_days, resolution, stratum, churn_90d, cohort_date FROM (
    SELECT * REPLACE ({Q.canonical_sha256("span_hash")} AS span_hash, {Q.canonical_label("resolution")} AS resolution, {Q.canonical_label("stratum")} AS stratum) FROM observations)
  WHERE cohort IS NOT NULL AND span_hash IS NOT NULL AND offset_days IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY cohort, span_hash, offset_days ORDER BY batch DESC NULLS LAST, written_at DESC NULLS LAST,
    resolution DESC NULLS LAST, stratum DESC NULLS LAST, churn_90d DESC NULLS LAST, cohort_date DESC NULLS LAST) = 1
)"""


def _first_sql(event: str) -> str:
    return f"""{_OBS}, firsts AS (
  SELECT cohort, span_hash, arg_min(stratum, offset_days) FILTER (WHERE stratum IS NOT NULL) AS stratum,
    arg_min(churn_90d, offset_days) FILTER (WHERE churn_90d IS NOT NULL) AS churn_90d,
    coalesce(min(offset_days) FILTER (WHERE resolution = '{event}'), max(offset_days))::DOUBLE AS time,
    coalesce(bool_or(resolution = '{event}'), false) AS event
  FROM obs GROUP BY cohort, span_hash
)"""


def _curve_sql(table: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    comma = f"{by}, " if by else ""
    return f"""tally AS (SELECT {comma}time, count(*) AS n, count(*) FILTER (WHERE event) AS events FROM {table} GROUP BY ALL),
risk AS (SELECT *, sum(n) OVER ({part} ORDER BY time DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS at_risk FROM tally),
curve AS (SELECT {comma}time, at_risk, events, product(1 - events / at_risk) OVER ({part} ORDER BY time ROWS UNBOUNDED PRECEDING) AS survival FROM risk WHERE events > 0)
"""


_ROUNDED = "time, at_risk, events, round(survival, 9) AS survival FROM curve"
_RETIRE = f"""WITH {_OBS}, h AS (
  SELECT cohort, span_hash, offset_days AS seq, cohort_date::DATE + offset_days AS d, coalesce(resolution = 'destroyed', false) AS gone FROM obs
), r AS (
  SELECT *, sum((NOT gone)::INT) OVER (PARTITION BY cohort, span_hash ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) = 0 AS in_run FROM h
), p AS (
  SELECT cohort, span_hash, count(*) FILTER (WHERE in_run) AS n_run,
    (arg_max(d, seq) FILTER (WHERE in_run) - arg_min(d, seq) FILTER (WHERE in_run))::DOUBLE AS elapsed_days FROM r GROUP BY ALL
), proposals AS (SELECT *, n_run >= 3 AND coalesce(elapsed_days >= 14, false) AS propose FROM p)
"""
_DIGIT = "\\p{Nd}"
_STRATUM = f"""CASE WHEN regexp_matches(SPAN, '{_DIGIT}') THEN 'numeric' WHEN len(regexp_extract_all({Q.normalize("SPAN")}, '{Q.TECHNICAL_TOKEN}')) > 0 THEN 'identifier'
  WHEN SPAN IS NOT NULL THEN 'prose' END"""
_ELIGIBLE = f"""WITH RECURSIVE {_LAST}, {structure_ctes("docs", "id")}, pieces AS (
  SELECT id, source, doc_key, t, {Q.strip("piece")} AS span FROM (
    SELECT *, unnest(string_split(regexp_replace(t, '([.!?])[{Q.WS}]+', '\\1' || chr(1), 'g'), chr(1))) AS piece FROM docs)
), sized AS (
  SELECT *, strpos(t, span)::INT - 1 AS start_at FROM pieces WHERE length(span) BETWEEN 40 AND 400 AND strpos(t, span) > 0
), eligible AS (
  SELECT s.* FROM sized s
  WHERE NOT contains(substr(t, start_at + 2), span)
    AND EXISTS (SELECT 1 FROM heads h WHERE h.id = s.id AND h.start_at <= s.start_at AND s.start_at < h.end_at)
    AND NOT EXISTS (SELECT 1 FROM fence_regions r WHERE r.id = s.id AND r.start_at <= s.start_at AND s.start_at < r.end_at)
)
"""

QUERIES = {
    f.__name__: f
    for f in (
        observations_clean, strata, auto_generated, eligible_spans, eligible_per_document, quarter_cohorts, commits_per_quarter, drawn_documents, churn_90d,
        asof_commit, reachable_horizons, first_stale, distinct_anchors, kaplan_meier_stale, kaplan_meier_destroyed, kaplan_meier_by_stratum,
        kaplan_meier_by_churn, survival_report, resolution_histogram, destroyed_recovery, retirement_candidates, retirements_confirmed, tokens_verbatim, triage,
        dataset_hashes, run_metrics,
    )
}
ORACLES = {
    "observations_clean": f"WITH {_OBS} SELECT * FROM obs",
    "strata": f"SELECT {_STRATUM.replace('SPAN', 'span_text')} AS stratum, count(*) AS n_spans FROM (SELECT DISTINCT span_text FROM anchors) GROUP BY 1",
    "auto_generated": r"""SELECT source, count(*) AS n, count(*) FILTER (WHERE contains(regexp_extract(text, '(?s)\A---\n(.*?)\n---\n', 1), 'auto_generated: true')) AS n_generated
FROM documents GROUP BY source""",
    "eligible_spans": _ELIGIBLE + f"SELECT doc_key, md5(span) AS span, start_at, {_STRATUM.replace('SPAN', 'span')} AS stratum FROM eligible",
    "eligible_per_document": _ELIGIBLE
    + """SELECT source, (list(n ORDER BY n))[len(list(n)) // 2 + 1]::INT AS median_spans FROM (SELECT source, id, count(*) AS n FROM eligible GROUP BY ALL) GROUP BY source""",
    "quarter_cohorts": f"""SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, o_orderkey FROM orders WHERE o_orderkey IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY year(o_orderdate), quarter(o_orderdate) ORDER BY md5('{SEED}|' || o_orderkey), o_orderkey) = 1""",
    "commits_per_quarter": "SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS n FROM orders GROUP BY 1",
    "drawn_documents": f"""SELECT doc_id, source FROM (SELECT DISTINCT doc_id, source FROM documents) WHERE doc_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}|' || doc_id), doc_id) <= 50""",
    "churn_90d": """WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n_day FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)
SELECT day, n_day, sum(n_day) OVER (ORDER BY day RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW)::BIGINT AS n_trailing FROM d""",
    "asof_commit": """WITH a AS (SELECT DISTINCT cohort, (cohort_date::DATE - INTERVAL 27 YEARS)::TIMESTAMP AS asked_at FROM observations WHERE cohort IS NOT NULL AND cohort_date IS NOT NULL)
SELECT cohort, strftime(asked_at, '%Y-%m-%d') AS asked_on, (SELECT max((o_orderdate::TIMESTAMP, o_orderkey))[2] FROM orders WHERE o_orderdate::TIMESTAMP <= asked_at) AS o_orderkey FROM a""",
    "reachable_horizons": f"""SELECT h::INT AS offset_days, count(*) AS n, count(*) FILTER (WHERE d + h::INT <= DATE '{ANALYSIS_DATE}') AS observable,
  round(1 - count(*) FILTER (WHERE d + h::INT <= DATE '{ANALYSIS_DATE}') / count(*), 9) AS censored
FROM (SELECT DISTINCT cohort, cohort_date::DATE AS d FROM observations WHERE cohort IS NOT NULL AND cohort_date IS NOT NULL), unnest([7, 14, 30, 60, 90, 180, 365]) u(h) GROUP BY h""",
    "first_stale": f"WITH {_first_sql('stale')} SELECT * FROM firsts",
    "distinct_anchors": f"WITH {_OBS} SELECT count(DISTINCT (cohort, span_hash)) AS n_anchors FROM obs",
    "kaplan_meier_stale": f"WITH {_first_sql('stale')}, {_curve_sql('firsts')} SELECT {_ROUNDED}",
    "kaplan_meier_destroyed": f"WITH {_first_sql('destroyed')}, {_curve_sql('firsts')} SELECT {_ROUNDED}",
    "kaplan_meier_by_stratum": f"WITH {_first_sql('stale')}, {_curve_sql('firsts', 'stratum')} SELECT stratum, {_ROUNDED}",
    "kaplan_meier_by_churn": f"""WITH {_first_sql("stale")}, split AS (
  SELECT *, CASE WHEN churn_90d > (SELECT (list(churn_90d ORDER BY churn_90d))[count(*) // 2 + 1] FROM firsts WHERE churn_90d IS NOT NULL) THEN 'high' ELSE 'low' END AS churn
  FROM firsts WHERE churn_90d IS NOT NULL), {_curve_sql("split", "churn")} SELECT churn, {_ROUNDED}""",
    "survival_report": f"""WITH {_first_sql("stale")}, known AS (SELECT * FROM firsts WHERE stratum IS NOT NULL), {_curve_sql("known", "stratum")},
g AS (SELECT stratum, count(*) AS n, count(*) FILTER (WHERE event) AS n_events FROM known GROUP BY 1)
SELECT stratum, n, n_events, (SELECT min(time) FROM curve c WHERE c.stratum = g.stratum AND survival <= 0.5) AS median, h::DOUBLE AS horizon,
  round(coalesce((SELECT arg_max(survival, time) FROM curve c WHERE c.stratum = g.stratum AND c.time <= h), 1.0), 9) AS survival
FROM g, unnest([7, 14, 30, 60, 90, 180, 365]) u(h)""".replace("curve AS (", "curve AS (").replace("FROM risk WHERE events > 0)\n,", "FROM risk WHERE events > 0),"),
    "resolution_histogram": f"WITH {_OBS} SELECT resolution, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 9) AS percent FROM obs WHERE resolution IS NOT NULL GROUP BY 1",
    "destroyed_recovery": f"""WITH {_OBS}, s AS (SELECT cohort, span_hash, min(offset_days) FILTER (WHERE resolution = 'destroyed') AS lost,
  max(offset_days) FILTER (WHERE resolution IN ('valid', 'valid_repaired', 'valid_relocated')) AS last_found FROM obs GROUP BY ALL)
SELECT count(*) AS ever_destroyed, count(*) FILTER (WHERE last_found > lost) AS recovered FROM s WHERE lost IS NOT NULL""",
    "retirement_candidates": _RETIRE + "SELECT cohort, span_hash, n_run, round(elapsed_days, 6) AS elapsed_days, propose FROM proposals WHERE n_run > 0",
    "retirements_confirmed": _RETIRE + "SELECT propose, propose AND cohort % 2 = 0 AS may_retire, count(*) AS n FROM proposals GROUP BY ALL",
    "tokens_verbatim": f"""WITH a AS (SELECT anchor_ord, max(span_text) AS span_text FROM anchors WHERE anchor_ord IS NOT NULL GROUP BY 1),
c AS (SELECT candidate_id, any_value(question) AS question, any_value(anchor_ord) AS anchor_ord, any_value(quoted_span) AS quoted_span FROM candidates WHERE candidate_id IS NOT NULL GROUP BY 1)
SELECT candidate_id, coalesce({Q.normalize("quoted_span")} <> '' AND contains({Q.normalize("span_text")}, {Q.normalize("quoted_span")}), false) AS grounded,
  CASE WHEN question IS NOT NULL AND span_text IS NOT NULL THEN array_to_string(list_filter(regexp_extract_all({Q.normalize("question")}, '{Q.TECHNICAL_TOKEN}'),
    lambda t: NOT contains({Q.normalize("span_text")}, t)), '|') END AS missing
FROM c LEFT JOIN a USING (anchor_ord)""",
    "triage": f"""WITH a AS (SELECT anchor_ord, max(span_text) AS span_text FROM anchors WHERE anchor_ord IS NOT NULL GROUP BY 1),
c AS (SELECT candidate_id, (max((question, bucket)))[1] AS question, {Q.canonical_label("(max((question, bucket)))[2]")} AS given, any_value(anchor_ord) AS anchor_ord,
  any_value(quoted_span) AS quoted_span FROM candidates WHERE candidate_id IS NOT NULL GROUP BY 1),
n AS (SELECT candidate_id, given, {Q.normalize("question")} AS q, {Q.normalize("quoted_span")} AS quoted, {Q.normalize("span_text")} AS span FROM c LEFT JOIN a USING (anchor_ord)),
r AS (SELECT candidate_id, given, lower(q) AS asked, CASE WHEN NOT coalesce(quoted <> '' AND contains(span, quoted), false) THEN 'reject_ungrounded'
  WHEN coalesce(len(list_filter(regexp_extract_all(q, '{Q.TECHNICAL_TOKEN}'), lambda t: NOT contains(span, t))) > 0, true) THEN 'reject_token_mismatch'
  WHEN given IN {G.REJECTED} THEN given WHEN given IS NULL OR given NOT IN {G.PRIMARY + G.EXPLORATORY} THEN 'reject_unanswerable' END AS reason FROM n),
f AS (SELECT asked, min(candidate_id) AS first FROM r WHERE reason IS NULL GROUP BY 1),
b AS (SELECT candidate_id, coalesce(reason, CASE WHEN candidate_id > first THEN 'reject_duplicate' END, given) AS bucket FROM r LEFT JOIN f USING (asked))
SELECT candidate_id, bucket, bucket IN {G.PRIMARY} AS "primary" FROM b""",
    "dataset_hashes": """SELECT benchmark_id, sha256(string_agg(test_id || chr(0) || q || chr(10), '' ORDER BY test_id)) AS dataset_hash FROM (
  SELECT benchmark_id, test_id, max(coalesce(question, '')) AS q FROM test_cases WHERE test_id IS NOT NULL GROUP BY ALL) GROUP BY benchmark_id""",
    "run_metrics": """WITH t AS (SELECT test_id, max(benchmark_id) AS benchmark_id, max(expected_doc_key) AS e FROM test_cases WHERE test_id IS NOT NULL GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY benchmark_id ORDER BY test_id) AS k FROM t),
h AS (SELECT a.benchmark_id, a.test_id, a.e, b.e AS doc_key, ((b.k - a.k) + a.k % 7) % 10 + 1 AS rank, a.k * 1.5 AS latency
      FROM k a JOIN k b ON a.benchmark_id = b.benchmark_id AND b.k - a.k BETWEEN 0 AND 9 WHERE a.e IS NOT NULL),
p AS (SELECT benchmark_id, test_id, min(rank) FILTER (WHERE doc_key = e) AS at_rank, count(*) FILTER (WHERE doc_key = e AND rank <= 10) AS good,
      count(*) FILTER (WHERE rank <= 10) AS shown, max(latency) AS latency FROM h GROUP BY ALL)
SELECT benchmark_id, count(*) AS n, round(avg(coalesce((at_rank <= 1)::DOUBLE, 0)), 9) AS recall_at_1, round(avg(coalesce((at_rank <= 3)::DOUBLE, 0)), 9) AS recall_at_3,
  round(avg(coalesce((at_rank <= 5)::DOUBLE, 0)), 9) AS recall_at_5, round(avg(coalesce((at_rank <= 10)::DOUBLE, 0)), 9) AS recall_at_10,
  round(avg(coalesce(1 / at_rank, 0)), 9) AS mrr, round(avg(coalesce(1 / at_rank, 0)), 9) AS map, round(avg(coalesce(1 / log2(at_rank + 1), 0)), 9) AS ndcg,
  round(avg(CASE WHEN shown > 0 THEN good / shown ELSE 0 END), 9) AS precision_at_10, round(avg((shown > 0 AND coalesce(at_rank, 0) <> 1)::DOUBLE), 9) AS wrong_top_1,
  count(*) FILTER (WHERE shown = 0) AS empty, round(quantile_cont(latency::DOUBLE, 0.5), 9) AS median_latency, round(quantile_cont(latency::DOUBLE, 0.95), 9) AS p95_latency
FROM p GROUP BY benchmark_id""",
}
