"""Checks of generated questions against their evidence, and of search results against expectations.

The definitions of the measures are the standard ones: a test has one relevant document, so context
precision at k is the share of the first k hits that are relevant, recall at k whether it is among them,
the reciprocal rank and the average precision are one over its rank, and nDCG is ``1 / log2(1 + rank)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import canonical_label, missing_tokens, normalize, technical_tokens
from spanwright.operators.ordered_hash import ordered_hash

RECALL_AT = (1, 3, 5, 10)


def grounding(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(candidate_id, grounded, missing)`` for ``candidates(candidate_id, question, anchor_ord, quoted_span)``.

    Grounded if the quoted span stands in its anchor's text, character by character after normalization;
    ``missing`` are the question's technical tokens that the anchor's text lacks. Null span, null anchor
    or unknown anchor: not grounded, and ``missing`` is null. One row for each candidate id.
    """
    texts = anchors.where("anchor_ord IS NOT NULL").groupBy("anchor_ord").agg(F.max("span_text").alias("span_text"))
    one = candidates.where("candidate_id IS NOT NULL").groupBy("candidate_id").agg(F.max(F.struct("question", "anchor_ord", "quoted_span")).alias("c")).select("candidate_id", "c.*")
    joined = one.join(texts, "anchor_ord", "left").select(
        "candidate_id",
        technical_tokens(F.col("question")).alias("tokens"),
        normalize(F.col("quoted_span")).alias("quoted"),
        normalize(F.col("span_text")).alias("span"),
    )
    grounded = F.coalesce((F.col("quoted") != "") & F.contains("span", F.col("quoted")), F.lit(False))
    return joined.select("candidate_id", grounded.alias("grounded"), missing_tokens(F.col("tokens"), F.col("span")).alias("missing"))


#: Buckets of a triage: those a benchmark takes, those to look at, and the reasons to reject.
PRIMARY = ("factual_lookup", "identifier_lookup", "table_lookup", "cross_reference", "applicability_scoped")
EXPLORATORY = ("multi_hop", "ambiguous_intent")
REJECTED = ("reject_ungrounded", "reject_token_mismatch", "reject_duplicate", "reject_unanswerable")


def triage(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(candidate_id, bucket, primary)``: the bucket a candidate is in after the checks that need no judgement.

    Rejected, in this order, are candidates that aren't grounded, whose question has technical tokens that the
    anchor lacks, and whose question, in normal form and without regard to case, an accepted candidate with a lesser id asks
    too. Others keep the bucket they were given, if it is one; a missing or unknown one is ``reject_unanswerable``.
    One row for each candidate id, of rows that differ the greatest.
    """
    given = candidates.where("candidate_id IS NOT NULL").groupBy("candidate_id").agg(F.max(F.struct("question", "bucket")).alias("c"))
    checked = given.select("candidate_id", F.lower(normalize(F.col("c.question"))).alias("asked"), canonical_label(F.col("c.bucket")).alias("given")).join(
        grounding(candidates, anchors), "candidate_id"
    )
    known = F.col("given").isin(*PRIMARY, *EXPLORATORY, *REJECTED)
    reason = (
        F.when(~F.col("grounded"), "reject_ungrounded")
        .when(F.coalesce(F.size("missing") > 0, F.lit(True)), "reject_token_mismatch")
        .when(known & F.startswith("given", F.lit("reject_")), F.col("given"))
        .when(~F.coalesce(known, F.lit(False)), "reject_unanswerable")
    )
    held = checked.withColumn("reason", reason)
    # only the least accepted id of a question is needed, so a question that is asked often isn't gathered
    first = held.where("reason IS NULL").groupBy("asked").agg(F.min("candidate_id").alias("first"))
    bucket = F.coalesce("reason", F.when(F.col("candidate_id") > F.col("first"), "reject_duplicate"), "given")
    out = held.join(first, "asked", "left").select("candidate_id", bucket.alias("bucket"))
    return out.withColumn("primary", F.col("bucket").isin(*PRIMARY))


def metric_deltas(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, measure, before, after, delta)`` of two tables of measures; a group that only one has keeps nulls."""

    def long(df: DataFrame, name: str) -> DataFrame:
        measures = [c for c in df.columns if c not in by]
        rows = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias(name)) for c in measures)))
        return df.select(*by, rows.alias("m")).select(*by, "m.*")

    return long(before, "before").join(long(after, "after"), [*by, "measure"], "full").withColumn("delta", F.col("after") - F.col("before"))


def retrieval_metrics(hits: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Measures of ``hits(*by, test_id, rank, doc_key, latency_ms)`` against ``expected(test_id, expected_doc_key)``.

    One row for each group of ``by``: ``n``, ``recall_at_k``, ``mrr``, ``map``, ``ndcg``, ``precision_at_10``,
    ``wrong_top_1``, ``empty``, ``median_latency``, ``p95_latency``. A run's row with a null rank says that
    the test found nothing (or failed); it counts as empty. Ranks begin at 1; the first hit of the expected
    document counts. Tests without expectation are left out.
    """
    known = expected.where("test_id IS NOT NULL AND expected_doc_key IS NOT NULL").groupBy("test_id").agg(F.max("expected_doc_key").alias("expected_doc_key"))
    one = hits.join(known, "test_id")
    right = F.col("doc_key") == F.col("expected_doc_key")
    per_test = one.groupBy(*by, "test_id").agg(
        F.min(F.when(right, F.col("rank"))).alias("at"),
        F.count_if(right & (F.col("rank") <= 10)).alias("good"),
        F.count_if(F.col("rank") <= 10).alias("shown"),
        F.max("latency_ms").alias("latency"),
    )
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return per_test.groupBy(*by).agg(
        F.count("*").alias("n"),
        *(F.avg(F.coalesce((F.col("at") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in RECALL_AT),
        mean(1 / F.col("at")).alias("mrr"),
        mean(1 / F.col("at")).alias("map"),
        mean(1 / F.log2(F.col("at") + 1.0)).alias("ndcg"),
        mean(F.when(F.col("shown") > 0, F.col("good") / F.col("shown"))).alias("precision_at_10"),
        F.avg(((F.col("shown") > 0) & (F.coalesce("at", F.lit(0)) != 1)).cast("double")).alias("wrong_top_1"),
        F.count_if(F.col("shown") == 0).alias("empty"),
        F.percentile("latency", 0.5).alias("median_latency"),
        F.percentile("latency", 0.95).alias("p95_latency"),
    )


class NotComparable(ValueError):
    """Two runs over other data, settings, targets or tests."""


RUN_KEYS = ("dataset_hash", "config_hash", "target_id")


def compare_runs(run_a: DataFrame, hits_a: DataFrame, run_b: DataFrame, hits_b: DataFrame, expected: DataFrame) -> DataFrame:
    """Per test, the rank of the expected document in two runs, and whether it got worse: ``(test_id, rank_a, rank_b, regressed)``.

    Raises unless dataset, settings, target and the set of tests agree.
    """
    a, b = (r.select(*RUN_KEYS).first() for r in (run_a, run_b))
    if a != b:
        raise NotComparable(f"runs differ in {[k for k in RUN_KEYS if a is None or b is None or a[k] != b[k]]}")
    tests = [h.select("test_id").distinct() for h in (hits_a, hits_b)]
    if tests[0].exceptAll(tests[1]).limit(1).count() or tests[1].exceptAll(tests[0]).limit(1).count():
        raise NotComparable("runs differ in their tests")

    def ranks(hits: DataFrame, name: str) -> DataFrame:
        right = F.col("doc_key") == F.col("expected_doc_key")
        return hits.join(expected.select("test_id", "expected_doc_key").distinct(), "test_id").groupBy("test_id").agg(F.min(F.when(right, F.col("rank"))).alias(name))

    joined = ranks(hits_a, "rank_a").join(ranks(hits_b, "rank_b"), "test_id")
    worse = F.col("rank_a").isNotNull() & (F.col("rank_b").isNull() | (F.col("rank_b") > F.col("rank_a")))
    return joined.withColumn("regressed", worse)


def dataset_hash(tests: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, dataset_hash)``: SHA-256 over ``test_id NUL question NL`` of the tests in order of their ids. Repeated rows count once."""
    rows = tests.where("test_id IS NOT NULL").groupBy(*by, "test_id").agg(F.max(F.coalesce("question", F.lit(""))).alias("question"))
    line = F.concat("test_id", F.lit("\x00"), "question", F.lit("\n"))
    return ordered_hash(rows, by, "test_id", line).select(*by, F.col("hash").alias("dataset_hash"))
