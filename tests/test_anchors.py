"""The families of edits, on a small manual of our own."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spanwright.operators import anchors as A
from spanwright.operators.snapshots import IncompatibleSnapshots, build_diff, build_snapshot, load_markdown, snapshot_ids

BASE = {
    "pump.md": "# 1 Guide\n\nIntro of the pump.\n\n## 1.1 Priming\n\nFill the housing, then open valve V_3=on before\nthe first start - never later.\n\n## 1.2 Limits\n\nThe flow must stay below 40 litres.\nKeep a log.\n",
    "fan.md": "# 2 Fan\n\nThe fan is cooled by air.\n\n## 2.1 Noise\n\nNoise is measured at one metre.\n",
}
SPAN = "The flow must stay below 40 litres."


def edit(old, new, key="pump.md"):
    return BASE | {key: BASE[key].replace(old, new)}


SECTION = "## 1.2 Limits\n\nThe flow must stay below 40 litres.\nKeep a log.\n"
FAMILIES = {
    "no change": (BASE, "valid"),
    "white space only": (edit("below 40 litres", "below  40 litres"), "valid"),
    "dash": (edit("start - never", "start – never"), "valid"),
    "section above": (edit("## 1.1", "## 1.0 New\n\nMuch.\n\n## 1.1"), "valid_repaired"),
    "neighbour reworded": (edit("Keep a log", "Keep a book"), "valid_repaired"),
    "leaf renamed": (edit("1.2 Limits", "1.2 Bounds"), "valid_relocated"),
    "ancestor renamed": (edit("1 Guide", "1 Guido"), "valid_repaired"),
    "moved to other file": ({"pump.md": BASE["pump.md"].replace(SECTION, ""), "fan.md": BASE["fan.md"] + "\n" + SECTION}, "valid_relocated"),
    "split": (BASE | {"pump.md": BASE["pump.md"].replace(SECTION, ""), "limits.md": SECTION}, "valid_relocated"),
    "merged above": ({"pump.md": BASE["fan.md"] + "\n" + BASE["pump.md"]}, "valid_repaired"),
    "reworded": (edit(SPAN, "The flow must remain small."), "stale"),
    "number changed": (edit("40 litres", "45 litres"), "stale"),
    "ancestor renamed and reworded": (edit("1 Guide", "1 Book") | {"pump.md": edit("1 Guide", "1 Book")["pump.md"].replace("40", "41")}, "stale"),
    "duplicated": (BASE | {"fan.md": BASE["fan.md"] + "\n" + SECTION}, "ambiguous"),
    "body deleted": (edit("The flow must stay below 40 litres.\nKeep a log.\n", ""), "destroyed"),
    "document gone": ({"fan.md": BASE["fan.md"]}, "destroyed"),
}


def documents(spark, corpus):
    raw = spark.createDataFrame(list(corpus.items()) or [], "doc_key string, raw string")
    return load_markdown(raw)


def as_target(docs):
    return docs.select(F.lit("s").alias("source"), "doc_key", F.col("normalized_text").alias("text"), "headings")


@pytest.fixture(scope="module")
def anchor(spark):
    wanted = spark.createDataFrame([(1, "s", "pump.md", SPAN, 0)], "request_id bigint, source string, doc_key string, span string, occurrence int")
    anchors, rejects = A.capture(wanted, as_target(documents(spark, BASE)))
    assert rejects.count() == 0
    return anchors.withColumnRenamed("request_id", "anchor_ord").collect()


def table(spark, anchor):
    return spark.createDataFrame(
        anchor, "anchor_ord bigint, source string, doc_key string, heading_path array<string>, span_hash string, context_hash string, char_range struct<start:int,end:int>, span_text string"
    )


def test_families(spark, anchor):
    """All families at once: each corpus is a source of its own."""
    targets, anchors = None, None
    for name, (corpus, _) in FAMILIES.items():
        docs = as_target(documents(spark, corpus)).withColumn("source", F.lit(name))
        mine = table(spark, anchor).withColumn("source", F.lit(name)).withColumn("anchor_ord", F.lit(list(FAMILIES).index(name)).cast("bigint"))
        targets = docs if targets is None else targets.unionByName(docs)
        anchors = mine if anchors is None else anchors.unionByName(mine)
    for rare in (True, False):
        rows = A.resolve(anchors, targets, rare_token=rare)[0].collect()
        got = {list(FAMILIES)[r.anchor_ord]: r.resolution for r in rows}
        assert got == {name: outcome for name, (_, outcome) in FAMILIES.items()}
    stale = next(r for r in rows if list(FAMILIES)[r.anchor_ord] == "number changed")
    assert stale.candidate_spans == ["The flow must stay below 45 litres.\nKeep a log."] and stale.new_heading_path == ["1 Guide", "1.2 Limits"]


def test_unsound_repeated_and_null_anchors(spark, anchor):
    one = table(spark, anchor).withColumn("text", F.lit("clash")).withColumn("n", F.lit(7))
    broken = one.withColumn("anchor_ord", F.lit(2).cast("bigint")).withColumn("span_text", F.lit("other"))
    null = one.withColumn("anchor_ord", F.lit(3).cast("bigint")).withColumn("span_text", F.lit(None).cast("string"))
    keyless = one.withColumn("anchor_ord", F.lit(4).cast("bigint")).withColumn("doc_key", F.lit(None).cast("string"))
    good, bad = A.resolve(one.unionByName(one).unionByName(broken).unionByName(null).unionByName(keyless), as_target(documents(spark, BASE)))
    assert sorted((r.anchor_ord, r.resolution) for r in good.collect()) == [(1, "valid"), (4, "valid_relocated")]
    assert sorted(r.anchor_ord for r in bad.collect()) == [2, 3]


def test_empty_tables(spark, anchor):
    nothing = as_target(documents(spark, {}))
    assert [r.resolution for r in A.resolve(table(spark, anchor), nothing)[0].collect()] == ["destroyed"]
    assert A.resolve(table(spark, []), nothing)[0].count() == 0


def test_capture_rejects(spark):
    wanted = spark.createDataFrame(
        [(1, "s", "no.md", "x", 0), (2, "s", "fan.md", "nowhere", 0), (3, "s", "fan.md", "Noise", 5), (4, "s", "fan.md", None, 0), (5, "s", "fan.md", "Noise", -1)],
        "request_id bigint, source string, doc_key string, span string, occurrence int",
    )
    anchors, rejects = A.capture(wanted, as_target(documents(spark, BASE)))
    assert {r.request_id: r.reason for r in rejects.collect()} == {1: "no such document", 2: "span not found", 3: "no such occurrence", 4: "span not found"}
    assert [r.char_range.start for r in anchors.collect()] == [len("# 2 Fan\n\nThe fan is cooled by air.\n\n## 2.1 Noise\n\n")]


def test_build_diff_guards_first_and_resolves_all(spark, anchor):
    a, docs_a = build_snapshot(documents(spark, BASE), "s", datetime(2025, 1, 1))
    b, docs_b = build_snapshot(documents(spark, FAMILIES["duplicated"][0]), "s", datetime(2025, 2, 1))
    changes, resolutions, unresolvable = build_diff(a, docs_a, b, docs_b, table(spark, anchor), datetime(2025, 3, 1))
    assert [(r.doc_key, r.change) for r in changes.collect()] == [("fan.md", "changed")]
    assert [r.resolution for r in resolutions.collect()] == ["ambiguous"] and unresolvable.count() == 0
    with pytest.raises(IncompatibleSnapshots, match="Recapture"):
        build_diff(a, docs_a, b.withColumn("normalizer_version", F.lit("9")), docs_b, table(spark, anchor), datetime(2025, 3, 1))


def test_snapshot_id(spark):
    docs = documents(spark, BASE)
    first, _ = build_snapshot(docs, "s", datetime(2025, 1, 1))
    later, _ = build_snapshot(docs.orderBy("doc_key"), "t", datetime(2026, 1, 1))
    other, _ = build_snapshot(documents(spark, FAMILIES["reworded"][0]), "s")
    ids = [h.first().snapshot_id for h in (first, later, other)]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 64
    assert build_snapshot(docs, "s", snapshot_id="abc")[0].first().snapshot_id == "abc"
    assert len(build_snapshot(documents(spark, {}), "s")[0].first().snapshot_id) == 64
    assert snapshot_ids(docs, [], "1").first().content_id != snapshot_ids(docs, [], "2").first().content_id


def test_resolve_all_in_order_or_not_at_all(spark, anchor):
    one = anchor[0].asDict()
    rows = [one | {"anchor_ord": k} for k in (3, 1, 2)]
    docs = as_target(documents(spark, BASE))
    schema = "anchor_ord bigint, source string, doc_key string, heading_path array<string>, span_hash string, context_hash string, char_range struct<start:int,end:int>, span_text string"
    make = lambda rows: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    assert [r.anchor_ord for r in A.resolve_all(make(rows), docs).collect()] == [1, 2, 3]
    with pytest.raises(A.Unresolvable, match="4"):
        A.resolve_all(make([*rows, one | {"anchor_ord": 4, "span_hash": "0" * 64}]), docs)
