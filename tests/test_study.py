from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanwright.functions.markdown import parse_headings
from spanwright.operators import grounding as G
from spanwright.operators import study as K
from spanwright.operators import study_run as R
from spanwright.operators.policy import ACTIONS, action_for, may_retire, retirement
from spanwright.streaming.retirement import retirement_stream


def curve(spark, rows):
    got = K.kaplan_meier(spark.createDataFrame(rows, "time double, event boolean")).orderBy("time").collect()
    return [(r.time, r.at_risk, r.events, round(r.survival, 9)) for r in got]


def test_textbook_curve(spark):
    assert curve(spark, [(5.0, True), (5.0, True), (10.0, False), (15.0, True), (20.0, False)]) == [(5, 5, 2, 0.6), (15, 2, 1, 0.3)]


def test_censoring_all_fail_and_empty(spark):
    rows = [(30.0, True)] * 50 + [(60.0, False)] * 40 + [(100.0, None)] * 10 + [(None, True)]
    assert curve(spark, rows) == [(30, 100, 50, 0.5)]
    assert curve(spark, [(14.0, True)] * 3) == [(14, 3, 3, 0.0)]
    assert curve(spark, []) == []


def test_median_and_steps(spark):
    df = spark.createDataFrame([("a", 30.0, 0.8), ("a", 60.0, 0.5), ("b", 30.0, 0.9)], "g string, time double, survival double")
    assert {r.g: r.median for r in K.median_survival(df, ["g"]).collect()} == {"a": 60.0, "b": None}
    at = {(r.g, r.horizon): r.survival for r in K.survival_at(df, df, ["g"], (7, 30, 59, 365)).collect()}
    assert at[("a", 7.0)] == 1.0 and at[("a", 59.0)] == 0.8 and at[("a", 365.0)] == 0.5 and at[("b", 30.0)] == 0.9


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4, None)] + [("b", 7)], "g string, x int")
    assert {r.g: r.median for r in K.upper_medians(df, ["g"], "x").collect()} == {"a": 3, "b": 7}


def test_as_of(spark):
    left = spark.createDataFrame([(1, datetime(2024, 1, 5)), (2, datetime(2023, 1, 1)), (3, datetime(2025, 9, 1)), (4, None)], "id int, at timestamp")
    right = spark.createDataFrame([(10, datetime(2024, 1, 5)), (11, datetime(2024, 1, 5)), (12, datetime(2024, 3, 1)), (13, None)], "k int, ts timestamp")
    assert {r.id: r.k for r in K.as_of(left, "at", right, "ts", "k").collect()} == {1: 11, 2: None, 3: 12, 4: None}
    assert {r.id: r.k for r in K.as_of(left, "at", right.limit(0), "ts", "k").collect()} == {1: None, 2: None, 3: None, 4: None}


def test_draw_is_stable(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    first = {r.id for r in K.draw(df, ["g"], "id", 5, "s").collect()}
    assert first == {r.id for r in K.draw(df.repartition(7).orderBy(F.rand(1)), ["g"], "id", 5, "s").collect()} and len(first) == 15


def history(spark, days, outcomes):
    rows = [(1, k, datetime(2024, 1, 1) + timedelta(days=d), o) for k, (d, o) in enumerate(zip(days, outcomes, strict=True))]
    return spark.createDataFrame(rows, "a int, seq int, observed_at timestamp, resolution string")


@pytest.mark.parametrize(
    ("days", "outcomes", "expected"),
    [([0, 20, 40], ["destroyed"] * 3, True), ([0, 0, 1], ["destroyed"] * 3, False), ([0, 20], ["destroyed"] * 2, False), ([0, 20, 30, 40], ["destroyed", "destroyed", "valid", "destroyed"], False), ([0, 20, 40, 60], ["destroyed", None, "destroyed", "destroyed"], False)],
)
def test_retirement(spark, days, outcomes, expected):
    row = retirement(history(spark, days, outcomes), ["a"]).first()
    assert row.propose is expected


def test_confirmation_and_actions(spark):
    proposed = retirement(history(spark, [0, 20, 40], ["destroyed"] * 3), ["a"])
    assert [may_retire(proposed, F.lit(c)).first().may_retire for c in ("ann", "", None)] == [True, False, False]
    df = spark.createDataFrame([(r,) for r in [*ACTIONS, "odd", None]], "r string")
    assert [x[0] for x in df.select(action_for(F.col("r"))).collect()] == [*ACTIONS.values(), None, None]


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(c, f"h{h}", s, datetime(2024, 1, 1) + timedelta(days=20 * s), "destroyed" if (c + h + s) % 4 else "valid") for c in range(3) for h in range(4) for s in range(6)]
    schema = "cohort int, span_hash string, seq bigint, observed_at timestamp, resolution string"
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[2] // 2 == k], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = retirement_stream(stream).writeStream.outputMode("update").format("memory").queryName("retire").trigger(availableNow=True)
    query = query.option("checkpointLocation", str(tmp_path / "cp")).start()
    assert query.awaitTermination(120)
    last = {}
    for r in spark.table("retire").collect():
        last[(r.cohort, r.span_hash)] = (r.n_run, r.propose)
    batch = retirement(spark.createDataFrame(rows, schema), ["cohort", "span_hash"]).collect()
    assert last == {(r.cohort, r.span_hash): (r.n_run, r.propose) for r in batch} and any(p for _, p in last.values())


def test_metrics_and_comparison(spark):
    expected = spark.createDataFrame([("t1", "d1"), ("t2", "d2"), ("t3", None)], "test_id string, expected_doc_key string")
    schema = "g string, test_id string, rank int, doc_key string, latency_ms double"
    hits = spark.createDataFrame([("g", "t1", 1, "d1", 5.0), ("g", "t1", 2, "x", 5.0), ("g", "t2", None, None, 9.0), ("g", "t3", 1, "z", 1.0)], schema)
    row = G.retrieval_metrics(hits, expected, ["g"]).first()
    assert (row.n, row.recall_at_1, row.mrr, row.empty, row.wrong_top_1, row.median_latency) == (2, 0.5, 0.5, 1, 0.0, 7.0)
    run = spark.createDataFrame([("d", "c", "t")], "dataset_hash string, config_hash string, target_id string")
    worse = spark.createDataFrame([("g", "t1", 3, "d1", 5.0), ("g", "t2", 1, "d2", 1.0), ("g", "t3", 1, "z", 1.0)], schema)
    got = {r.test_id: r.regressed for r in G.compare_runs(run, hits, run, worse, expected).collect()}
    assert got["t1"] is True and got["t2"] is False
    with pytest.raises(G.NotComparable):
        G.compare_runs(run, hits, run.withColumn("config_hash", F.lit("z")), worse, expected)


def study_tables(spark):
    headers = spark.createDataFrame([("s1", "m", datetime(2024, 1, 1)), ("s2", "m", datetime(2024, 1, 20)), ("s3", "m", datetime(2024, 3, 1))], "snapshot_id string, source string, captured_at timestamp")
    text = "# Guide\n\nThe flow of the pump must stay below {} litres at all times. Keep a careful log of every single start of the pump.\n"
    generated = "---\nauto_generated: true\n---\n" + text.format(1)
    docs = [(s, f"d{k}", text.format(10 * k + (k == 3 and s != "s1")), "clash") for s in ("s1", "s2", "s3") for k in range(1, 5)]
    docs += [("s1", "auto", generated, "clash"), ("s1", "empty", "", "clash"), ("s1", "none", None, "clash")]
    docs = spark.createDataFrame(docs, "snapshot_id string, doc_key string, text string, cohort string").drop("cohort")
    return headers, docs.withColumn("headings", parse_headings(F.col("text")))


def test_study_run(spark):
    headers, docs = study_tables(spark)
    cohorts = headers.where("snapshot_id = 's1'").withColumn("cohort", F.lit(1))
    anchors = R.draw_anchors(cohorts, docs, "seed", per_cohort=3)
    drawn = {(r.doc_key, r.span_text) for r in anchors.collect()}
    assert len(drawn) == 3 and {k for k, _ in drawn} <= {"d1", "d2", "d3", "d4"}
    assert drawn == {(r.doc_key, r.span_text) for r in R.draw_anchors(cohorts, docs.repartition(5), "seed", per_cohort=3).collect()}
    everything = R.draw_anchors(cohorts, docs, "seed", per_cohort=50)
    targets = R.targets(cohorts, headers)
    assert {(r.offset_days, r.observed_id) for r in targets.collect()} == {(7, "s1"), (14, "s1"), (30, "s2"), (60, "s3")}
    with pytest.raises(R.SelfComparison):
        R.observe(everything, targets, docs)
    seen, bad = R.observe(everything, targets.where("offset_days >= 30"), docs)
    rows = seen.collect()
    assert len(rows) == 8 and bad.count() == 0 and {r.resolution for r in rows if r.doc_key != "d3"} <= {"valid", "valid_repaired", "ambiguous"}
    assert R.observe(everything.limit(0), targets.where("offset_days >= 30"), docs)[0].count() == 0


def test_population_and_metadata(spark):
    assert R.check_population(spark.range(3), None) == R.check_population(spark.range(3), 3) == 3
    with pytest.raises(R.UnexpectedPopulation):
        R.check_population(spark.range(3), 4)
    seen = spark.createDataFrame([(1, "h", 7, "old"), (2, "h", 7, None)], "cohort int, span_hash string, offset_days int, doc_key string")
    about = spark.createDataFrame([(1, "h", None, "prose"), (1, "h", "d", None), (None, "h", "x", "x")], "cohort int, span_hash string, doc_key string, stratum string")
    assert {(r.cohort, r.doc_key, r.stratum) for r in R.with_anchor_metadata(seen, about).collect()} == {(1, "d", "prose"), (2, None, None)}


def test_as_of_over_many_partitions(spark):
    start = datetime(2024, 1, 1)
    right = [(k, start + timedelta(hours=(k * 37) % 500 if k % 3 else 100)) for k in range(400)]
    left = [(k, start + timedelta(minutes=61 * k)) for k in range(600)] + [(1000, start + timedelta(hours=100))] * 2
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frames = spark.createDataFrame(left, "id int, at timestamp"), spark.createDataFrame(right, "k int, ts timestamp")
        got = sorted((r.id, r.k) for r in K.as_of(frames[0], "at", frames[1], "ts", "k").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = [(i, max(((ts, k) for k, ts in right if ts <= at), default=(None, None))[1]) for i, at in left]
    assert got == sorted(want)
