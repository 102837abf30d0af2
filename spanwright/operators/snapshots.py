"""Freezing documents into snapshots, and comparing two of them."""

from __future__ import annotations

import hashlib
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.functions.markdown import LOADER, LOADER_VERSION, parse_headings
from spanwright.functions.text import NORMALIZER_VERSION, content_hash, normalize
from spanwright.operators.ordered_hash import ordered_hash


class IncompatibleSnapshots(ValueError):
    """Two snapshots that differ by more than their documents."""


def load_markdown(raw: DataFrame) -> DataFrame:
    """Documents from ``(doc_key, raw)`` and, if there, ``source_path``, which else is the key.

    Rows without key or text are left out; further columns are dropped.
    """
    path = F.coalesce("source_path", "doc_key") if "source_path" in raw.columns else F.col("doc_key")
    text = raw.where("doc_key IS NOT NULL AND raw IS NOT NULL").select(
        "doc_key", path.alias("source_path"), normalize(F.col("raw")).alias("normalized_text")
    )
    return text.select(
        "doc_key",
        "source_path",
        content_hash(F.col("normalized_text")).alias("content_hash"),
        "normalized_text",
        parse_headings(F.col("normalized_text")).alias("headings"),
        F.lit(LOADER).alias("loader"),
        F.lit(LOADER_VERSION).alias("loader_version"),
    )


def snapshot_ids(documents: DataFrame, by: list[str], normalizer_version: str = NORMALIZER_VERSION) -> DataFrame:
    """``(*by, content_id, n_documents)``: an id that depends on keys, contents and normalizer, not on time.

    Rows without key or hash are left out, a key delivered twice counts once (with its greatest hash).
    """
    once = documents.where("doc_key IS NOT NULL AND content_hash IS NOT NULL").groupBy(*by, "doc_key").agg(F.max("content_hash").alias("content_hash"))
    line = F.concat("doc_key", F.lit("\x00"), "content_hash", F.lit("\n"))
    return ordered_hash(once, by, "doc_key", line, normalizer_version + "\x00").withColumnsRenamed({"hash": "content_id", "n": "n_documents"})


def build_snapshot(
    documents: DataFrame, source: str, captured_at: datetime | None = None, snapshot_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Freeze loaded documents: ``(header, documents with snapshot_id)``.

    The id is the content's unless one is given; the time is now unless given. An empty table makes an empty
    snapshot of the Markdown loader. Two versions of one loader raise ``ValueError``.
    """
    spark = documents.sparkSession
    versions: dict[str, str] = {}
    for row in documents.select("loader", "loader_version").distinct().collect():
        if versions.setdefault(row["loader"], row["loader_version"]) != row["loader_version"]:
            raise ValueError(f"loader {row['loader']!r} has two versions")
    if snapshot_id is None or snapshot_id == "":
        ids = snapshot_ids(documents, []).collect()
        snapshot_id = ids[0]["content_id"] if ids else hashlib.sha256(f"{NORMALIZER_VERSION}\x00".encode()).hexdigest()
    header = spark.createDataFrame(
        [(snapshot_id, captured_at or datetime.now(UTC), source, NORMALIZER_VERSION, versions or {LOADER: LOADER_VERSION})],
        "snapshot_id string, captured_at timestamp, source string, normalizer_version string, loader_versions map<string,string>",
    )
    return header, documents.withColumn("snapshot_id", F.lit(snapshot_id))


def assert_comparable(a: DataFrame, b: DataFrame) -> None:
    """Raise unless two header rows agree on the normalizer and on the version of every loader both have."""
    x, y = a.select("normalizer_version", "loader_versions").first(), b.select("normalizer_version", "loader_versions").first()
    if x is None or y is None:
        raise ValueError("a snapshot has no header")
    if x["normalizer_version"] != y["normalizer_version"]:
        raise IncompatibleSnapshots(
            f"snapshots were normalized by versions {x['normalizer_version']} and {y['normalizer_version']}. Recapture one of them."
        )
    for loader in sorted((x["loader_versions"] or {}).keys() & (y["loader_versions"] or {}).keys()):
        v, w = x["loader_versions"][loader], y["loader_versions"][loader]
        if v != w:
            raise IncompatibleSnapshots(f"loader {loader!r} has versions {v} and {w}. Recapture one of the snapshots.")


def incompatible_pairs(headers: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same check for many pairs ``(from_snapshot_id, to_snapshot_id)``: those that can't be compared, with what differs.

    ``(from_snapshot_id, to_snapshot_id, what, from_version, to_version)``; ``what`` is ``normalizer`` or a loader.
    """
    one = headers.groupBy("snapshot_id").agg(F.min("normalizer_version").alias("n"), F.max_by("loader_versions", "captured_at").alias("l"))
    versions = one.select("snapshot_id", F.explode(F.map_concat(F.create_map(F.lit("normalizer"), "n"), F.coalesce("l", F.create_map().cast("map<string,string>")))).alias("what", "version"))
    a = versions.withColumnsRenamed({"snapshot_id": "from_snapshot_id", "version": "from_version"})
    b = versions.withColumnsRenamed({"snapshot_id": "to_snapshot_id", "version": "to_version"})
    return (
        pairs.join(a, "from_snapshot_id")
        .join(b, ["to_snapshot_id", "what"])
        .where("from_version <> to_version")
        .select("from_snapshot_id", "to_snapshot_id", "what", "from_version", "to_version")
    )


def diff_documents(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(doc_key, change)`` between two document tables with ``doc_key, content_hash``, sorted by key."""
    x = a.select("doc_key", F.col("content_hash").alias("x"))
    y = b.select("doc_key", F.col("content_hash").alias("y"))
    joined = x.withColumn("in_a", F.lit(True)).join(y.withColumn("in_b", F.lit(True)), "doc_key", "full")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return joined.select("doc_key", change.alias("change")).where("change IS NOT NULL").orderBy("doc_key")


def build_diff(header_a: DataFrame, docs_a: DataFrame, header_b: DataFrame, docs_b: DataFrame, anchors: DataFrame, computed_at: datetime):
    """Changes between two snapshots, and all anchors resolved against the second: ``(changes, resolutions, unresolvable)``.

    The guard is checked at once, before anything is resolved. Every anchor is resolved, also in documents
    that didn't change: what another document gained can make it ambiguous.
    """
    from spanwright.operators.anchors import resolve

    assert_comparable(header_a, header_b)
    documents = docs_b.select(F.lit("").alias("source"), "doc_key", F.col("normalized_text").alias("text"), "headings")
    resolutions, unresolvable = resolve(anchors.withColumn("source", F.lit("")), documents)
    stamp = F.lit(computed_at)
    return (
        diff_documents(docs_a, docs_b).withColumn("computed_at", stamp),
        resolutions.withColumn("computed_at", stamp).orderBy("anchor_ord"),
        unresolvable.withColumn("computed_at", stamp).orderBy("anchor_ord"),
    )
