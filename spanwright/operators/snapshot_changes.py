"""What changed between consecutive full snapshots of a source.

Each document of each snapshot is reduced in the JVM to a 128-bit key hash and a 128-bit hash of its
normalized text. Those compact rows are shuffled once, into hash buckets of the key. In a bucket numpy
sorts them and takes set differences of neighbouring snapshots by ``searchsorted``. Only the keys that
differ are joined back to their spelled-out values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.text import normalize
from spanwright.session import materialize

CHANGES = np.array(["added", "removed", "changed"], dtype=object)
_BUCKET_INPUT_BYTES = 64 << 20
#: Up to so many headers, ids of last snapshots are collected; beyond, they are joined.
MOST_HEADERS = 10_000


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a DataFrame, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def consecutive(headers: DataFrame) -> DataFrame:
    """Number the snapshots of each source by time: ``(snapshot_id, source, seq, n_snapshots)``.

    A header delivered twice counts once, at its earliest time; ties in time go by id. Headers without
    id, source or time can't be placed and are left out.
    """
    once = (
        headers.select("snapshot_id", "source", "captured_at")
        .dropna()
        .groupBy("snapshot_id")
        .agg(F.min(F.struct("captured_at", "source")).alias("h"))
        .select("snapshot_id", F.col("h.source").alias("source"), F.col("h.captured_at").alias("captured_at"))
    )
    by_time = Window.partitionBy("source").orderBy("captured_at", "snapshot_id")
    return once.select(
        "snapshot_id",
        "source",
        F.row_number().over(by_time).alias("seq"),
        F.count("*").over(Window.partitionBy("source")).cast("int").alias("n_snapshots"),
    )


def last_snapshots(headers: DataFrame) -> DataFrame:
    """``(snapshot_id, source)`` of the newest snapshot of each source."""
    return consecutive(headers).where("seq = n_snapshots").select("snapshot_id", "source")


def last_documents(headers: DataFrame, docs: DataFrame) -> DataFrame:
    """``(source, doc_key, normalized_text)`` of the documents in the last snapshot of each source.

    One row for each document: of several deliveries the latest, ties by text. The text is as delivered;
    rows without ``doc_key`` are left out. The headers are few, so the ids go into the scan as a filter.
    """
    last = last_snapshots(headers)
    ids = [r[0] for r in last.select("snapshot_id").collect()] if headers.count() <= MOST_HEADERS else None
    rows = docs.select("snapshot_id", "doc_key", "normalized_text", "delivered_at").where("doc_key IS NOT NULL")
    if ids is not None:
        rows = rows.where(F.col("snapshot_id").isin(ids))
    newest = rows.groupBy("snapshot_id", "doc_key").agg(F.max(F.struct("delivered_at", "normalized_text")).alias("d"))
    return newest.join(last, "snapshot_id").select("source", "doc_key", F.col("d.normalized_text").alias("normalized_text"))


def _bucket_changes(table: pa.Table) -> pa.Table:
    sources = table.column("source").combine_chunks().dictionary_encode()
    source = sources.indices.to_numpy()
    seq, n, k1, k2, r1, r2, delivered = (table.column(c).to_numpy() for c in ("seq", "n_snapshots", "k1", "k2", "r1", "r2", "delivered"))
    order = np.lexsort((r2, r1, delivered, k2, k1, seq, source))
    source, seq, n, k1, k2, r1, r2 = (a[order] for a in (source, seq, n, k1, k2, r1, r2))
    same = (source[1:] == source[:-1]) & (seq[1:] == seq[:-1]) & (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
    last = np.append(~same, True)  # of a document delivered more than once, the last delivery
    source, seq, n, k1, k2, r1, r2 = (a[last] for a in (source, seq, n, k1, k2, r1, r2))
    pairs = np.empty(len(k1), dtype=[("a", np.int64), ("b", np.int64)])
    pairs["a"], pairs["b"] = k1, k2
    first_of, key = np.unique(pairs, return_index=True, return_inverse=True)[1:]
    # one sorted code per (source, snapshot, key)
    width = len(first_of) + 1
    place = (source.astype(np.int64) * (int(n.max()) + 2) + seq) * width + key
    rows = np.argsort(place, kind="stable")
    sorted_place = place[rows]

    def find(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_place, wanted), len(rows) - 1)
        return sorted_place[at] == wanted, rows[at]

    out = []
    later = np.flatnonzero(seq > 1)
    found, before = find(place[later] - width)
    out.append((later[~found], seq[later[~found]] - 1, 0))
    both = later[found]
    differs = (r1[both] != r1[before[found]]) | (r2[both] != r2[before[found]])
    out.append((both[differs], seq[both[differs]] - 1, 2))
    earlier = np.flatnonzero(seq < n)
    found, _ = find(place[earlier] + width)
    out.append((earlier[~found], seq[earlier[~found]], 1))
    at = np.concatenate([o[0] for o in out])
    return pa.table(
        {
            "source": sources.dictionary.take(pa.array(source[at])),
            "from_seq": pa.array(np.concatenate([o[1] for o in out]).astype(np.int32)),
            "k1": pa.array(k1[at]),
            "k2": pa.array(k2[at]),
            "change": pa.array(CHANGES[np.repeat([o[2] for o in out], [len(o[0]) for o in out])], pa.string()),
        }
    )


def snapshot_changes(headers: DataFrame, docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Added, removed and changed documents for every two consecutive snapshots of a source.

    ``headers`` has ``snapshot_id, source, captured_at``; ``docs`` has ``snapshot_id, doc_key,
    normalized_text, delivered_at``. Further columns are ignored. Returns one row
    ``(from_snapshot_id, to_snapshot_id, source, doc_key, change)`` for each difference.

    Rows without ``doc_key`` or of an unknown snapshot are left out. Of a document delivered twice in one
    snapshot the latest delivery counts (a null time is the earliest; ties go by content hash). Texts are
    compared in normal form; a null text is a value of its own, equal only to another null. A snapshot
    without documents has removed all of its predecessor's. A moved document is removed and added.
    ``content_hash`` isn't read: it can be missing or wrong, and telling costs as much as hashing.
    """
    seqs = consecutive(headers)
    buckets = buckets or max(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(docs) // _BUCKET_INPUT_BYTES
    )
    keyed = docs.select("snapshot_id", "doc_key", "normalized_text", "delivered_at").where("doc_key IS NOT NULL")
    k1, k2 = F.xxhash64("doc_key"), F.xxhash64(F.lit("second"), F.col("doc_key"))
    text = normalize(F.col("normalized_text"))
    compact = (
        keyed.withColumn("t", text)
        .join(seqs, "snapshot_id")
        .select(
            "source",
            "seq",
            "n_snapshots",
            k1.alias("k1"),
            k2.alias("k2"),
            F.xxhash64(F.col("t").isNull(), F.col("t")).alias("r1"),
            F.xxhash64(F.lit("second"), F.col("t").isNull(), F.col("t")).alias("r2"),
            F.coalesce(F.unix_micros("delivered_at"), F.lit(-(1 << 62))).alias("delivered"),
        )
        .withColumn("bucket", F.pmod("k1", F.lit(buckets)))
    )
    # written, so that their size is known: few enough differing keys are broadcast to the scan of the keys
    differing = materialize(compact.groupBy("bucket").applyInArrow(_bucket_changes, "source string, from_seq int, k1 bigint, k2 bigint, change string"), "changes")
    names = keyed.select("doc_key", k1.alias("k1"), k2.alias("k2")).join(differing.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").distinct()
    ids = seqs.select("source", F.col("seq").alias("from_seq"), F.col("snapshot_id").alias("from_snapshot_id"))
    next_ids = seqs.select(
        "source", (F.col("seq") - 1).alias("from_seq"), F.col("snapshot_id").alias("to_snapshot_id")
    )
    return (
        differing.join(names, ["k1", "k2"])
        .join(ids, ["source", "from_seq"])
        .join(next_ids, ["source", "from_seq"])
        .select("from_snapshot_id", "to_snapshot_id", "source", "doc_key", "change")
    )
