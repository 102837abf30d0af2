from datetime import datetime

from spanwright.operators.snapshot_changes import last_documents, snapshot_changes

HEAD = "snapshot_id string, captured_at timestamp, source string, note string"
DOCS = "snapshot_id string, doc_key string, normalized_text string, delivered_at timestamp, source string"


def day(n):
    return datetime(2024, 1, n)


HEADERS = [("s2", day(2), "a", "x"), ("s1", day(1), "a", "x"), ("s1", day(1), "a", "x"), ("s3", day(3), "a", "x"), ("t1", day(1), "b", "x"), (None, day(1), "a", "x"), ("u", None, "a", "x")]
ROWS = [
    ("s1", "k1", "one", day(1), "clash"), ("s1", "k2", "two", day(1), "clash"), ("s1", "k3", "three", day(1), "clash"), ("s1", None, "one", day(1), "clash"), ("s1", "k5", None, None, ""),
    ("s2", "k1", "one  ", day(2), "clash"), ("s2", "k2", "old", day(2), "clash"), ("s2", "k2", "two!", day(5), "clash"), ("s2", "k2", "two!", day(5), "clash"), ("s2", "k4", "", day(2), "clash"), ("s2", "k5", "", None, ""),
    ("t1", "z", "z", day(1), "clash"), ("nope", "k9", "z", day(1), "clash"),
]
EXPECTED = {
    ("s1", "s2", "k2", "changed"), ("s1", "s2", "k3", "removed"), ("s1", "s2", "k4", "added"), ("s1", "s2", "k5", "changed"),
    ("s2", "s3", "k1", "removed"), ("s2", "s3", "k2", "removed"), ("s2", "s3", "k4", "removed"), ("s2", "s3", "k5", "removed"),
}


def test_changes(spark):
    for buckets in (1, 7):
        got = snapshot_changes(spark.createDataFrame(HEADERS, HEAD), spark.createDataFrame(ROWS, DOCS), buckets).collect()
        assert {(r.from_snapshot_id, r.to_snapshot_id, r.doc_key, r.change) for r in got} == EXPECTED and len(got) == len(EXPECTED)


def test_empty(spark):
    assert snapshot_changes(spark.createDataFrame([], HEAD), spark.createDataFrame([], DOCS)).count() == 0
    assert snapshot_changes(spark.createDataFrame(HEADERS, HEAD), spark.createDataFrame([], DOCS)).count() == 0


def test_last_documents(spark):
    headers = spark.createDataFrame([h for h in HEADERS if h[0] != "s3"], HEAD)
    got = {(r.source, r.doc_key, r.normalized_text) for r in last_documents(headers, spark.createDataFrame(ROWS, DOCS)).collect()}
    assert got == {("a", "k1", "one  "), ("a", "k2", "two!"), ("a", "k4", ""), ("a", "k5", ""), ("b", "z", "z")}
