import json
from pathlib import Path

from pyspark.sql import functions as F

from spanwright.operators import grounding as G
from spanwright.sources.loaders import documents_at, load_csv, load_text
from spanwright.sources.study_log import append_log, last_header, report_lines, write_report


def test_text_files(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.txt").write_text("one  two\r\n", encoding="utf-8")
    (tmp_path / "sub dir" / "b+c%.txt").write_text("x", encoding="utf-8")
    (tmp_path / "skip.md").write_text("# no", encoding="utf-8")
    rows = {r.doc_key: r for r in load_text(spark, str(tmp_path)).collect()}
    assert {k: r.normalized_text for k, r in rows.items()} == {"a.txt": "one two", "sub dir/b+c%.txt": "x"}
    assert all(r.headings == [] and r.loader == "text" for r in rows.values())


def test_csv_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,title,note\n1,"A, b",x\n2,,"two\nlines"\n,no key,y\n', encoding="utf-8")
    rows = load_csv(spark, str(tmp_path), "id", ["title", "note"]).collect()
    assert {(r.doc_key, r.normalized_text) for r in rows} == {("1", "title: A, b\nnote: x"), ("2", "note: two\nlines")}


def test_blobs_of_a_revision(spark):
    blobs = [("s", "b.md", b"caf\xc3\xa9"), ("s", "a.md", b"bad \xff byte"), ("s", "a.txt", b"x"), ("t", "c.md", b"x"), ("s", "n.md", None), ("s", "b.md", b"caf\xc3\xa9")]
    rows = documents_at(spark.createDataFrame(blobs, "sha string, path string, bytes binary"), "s").collect()
    assert [(r.doc_key, r.raw) for r in rows] == [("a.md", "bad � byte"), ("b.md", "café")]


def test_last_header(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "corpus_head string, analysis_date string, seed int, cohorts int, offsets_days array<int>"
    for k in (1, 2):
        append_log(spark.createDataFrame([(f"head{k}", "2024-01-01", k, 1, [7])], schema).coalesce(1), path, "run_header")
    files = sorted(Path(path).glob("*.json"), key=lambda f: f.read_text())
    import os

    for k, f in enumerate(files):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    assert [r.corpus_head for r in last_header(spark, path).collect()] == ["head2"]


def test_reports(spark, tmp_path):
    parts = {"mix": spark.createDataFrame([("valid", 3), ("stale", None)], "resolution string, n int"), "none": spark.createDataFrame([], "x int")}
    write_report(parts, str(tmp_path / "r"))
    (file,) = (tmp_path / "r").glob("*.json")
    assert json.loads(file.read_text()) == {"mix": [{"resolution": "stale"}, {"resolution": "valid", "n": 3}], "none": []}
    assert [r.line for r in report_lines(parts).collect()] == ["== mix", "resolution stale  n -", "resolution valid  n 3", "== none"]


def test_triage(spark):
    anchors = spark.createDataFrame([(1, "The flow of PUMP_A must stay below 40 litres.")], "anchor_ord bigint, span_text string")
    q = "What must the flow stay below?"
    rows = [
        ("a", q, 1, "below 40 litres", "Factual Lookup"),
        ("b", q.replace("W", "w"), 1, "below 40 litres", "factual_lookup"),
        ("c", q, 1, "below 41 litres", "factual_lookup"),
        ("d", "What of PUMP_B?", 1, "flow", "factual_lookup"),
        ("e", "And now?", 1, "flow", "multi_hop"),
        ("f", "Who?", 1, "flow", None),
        ("g", "Why?", None, "flow", "factual_lookup"),
        (None, q, 1, "flow", "factual_lookup"),
    ]
    got = G.triage(spark.createDataFrame(rows + rows[:2], "candidate_id string, question string, anchor_ord bigint, quoted_span string, bucket string"), anchors).collect()
    assert {r.candidate_id: (r.bucket, r.primary) for r in got} == {
        "a": ("factual_lookup", True), "b": ("reject_duplicate", False), "c": ("reject_ungrounded", False), "d": ("reject_token_mismatch", False),
        "e": ("multi_hop", False), "f": ("reject_unanswerable", False), "g": ("reject_ungrounded", False),
    }


def test_metric_deltas(spark):
    a = spark.createDataFrame([("x", 0.5, 1), ("y", 0.1, 2)], "g string, mrr double, n int")
    b = spark.createDataFrame([("x", 0.75, 1)], "g string, mrr double, n int")
    got = {(r.g, r.measure): (r.before, r.after, r.delta) for r in G.metric_deltas(a, b, ["g"]).orderBy(F.col("g")).collect()}
    assert got == {("x", "mrr"): (0.5, 0.75, 0.25), ("x", "n"): (1.0, 1.0, 0.0), ("y", "mrr"): (0.1, None, None), ("y", "n"): (2.0, None, None)}
