"""A sample of anchors that reruns, repartitioning and further deliveries leave as it is.

An anchor is identified by ``(cohort, span_hash)``. Its identifier is the 256-bit number that the hash
spells, in the fixed domain of its cohort. A balanced Feistel network, keyed by the seed and the cohort,
permutes that domain: being a bijection it has no collisions, and having no state it gives each anchor
the same value whatever else is in the table. An anchor is chosen if its value lies under
``rate x 2^256``. All of it is JVM expressions over one scan; only chosen rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.text import canonical_label, canonical_sha256, py_strip

ROUNDS = 4
#: The threshold is a multiple of 2^(256 - RATE_BITS).
RATE_BITS = 60


def _word(hex_digits: Column, k: int) -> Column:
    """The k-th 64-bit word of a hexadecimal number, as a signed integer."""
    return F.conv(F.substring(hex_digits, 16 * k + 1, 16), 16, -10).cast("bigint")


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, which projections that Catalyst merges don't ensure."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def permuted_top(span_hash: Column, cohort: Column, seed: str) -> Column:
    """The first 60 bits of an anchor's permuted identifier, which is ``(r0, r1, l0, l1)`` after the rounds."""

    def one_round(state: Column, n: Column) -> Column:
        parts = [F.lit(seed), n.cast("string"), cohort.cast("string"), state["r0"].cast("string"), state["r1"].cast("string")]
        return _bound(
            F.md5(F.concat_ws("|", *parts).cast("binary")),
            lambda digest: F.struct(
                state["r0"].alias("l0"),
                state["r1"].alias("l1"),
                state["l0"].bitwiseXOR(_word(digest, 0)).alias("r0"),
                state["l1"].bitwiseXOR(_word(digest, 1)).alias("r1"),
            ),
        )

    rounds = F.array(*(F.lit(n) for n in range(ROUNDS)))
    top = _bound(
        span_hash,
        lambda h: F.aggregate(
            rounds, F.struct(*(_word(h, k).alias(name) for k, name in enumerate(("l0", "l1", "r0", "r1")))), one_round
        )["r0"],
    )
    return F.shiftrightunsigned(top, 64 - RATE_BITS)


def stable_sample(observations: DataFrame, rate: float, seed: str = "spanwright") -> DataFrame:
    """Choose about ``rate`` of the anchors, with all their observations.

    Keeps every column of ``observations``, with ``span_hash``, ``resolution``, ``stratum`` and ``record``
    in their one spelling. An observation is ``(cohort, span_hash, offset_days, observed_sha, doc_key)``;
    delivered more than once, it appears once, as in its latest batch (ties by time, then by the remaining
    values). A row without ``doc_key`` is the observation of the one document known for its other four values;
    where none or several are known, it stays an observation of an unknown document.
    An anchor without cohort or readable hash has no identifier: it is in no sample. A rate of 0 gives no
    row, a rate of 1 every anchor.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie in 0..1")
    tidy = observations.withColumns(
        {"span_hash": canonical_sha256(F.col("span_hash"))}
        | {c: (canonical_label(F.col(c)) if c == "resolution" else F.lower(py_strip(F.col(c)))) for c in ("resolution", "stratum", "record")}
    ).where("cohort IS NOT NULL AND span_hash IS NOT NULL")
    top = permuted_top(F.col("span_hash"), F.col("cohort"), seed)
    chosen = tidy.where(top < F.lit(int(rate * (1 << RATE_BITS))))
    place = ["cohort", "span_hash", "offset_days", "observed_sha"]
    known, least = (f(F.col("doc_key")).over(Window.partitionBy(*place)) for f in (F.max, F.min))
    chosen = chosen.withColumn("doc_key", F.coalesce("doc_key", F.when(known == least, known)))
    key = [*place, "doc_key"]
    rest = [c for c in observations.columns if c not in key]
    first = [c for c in ("batch", "written_at") if c in rest]
    ordered = first + [c for c in rest if c not in first]
    latest = chosen.groupBy(*key).agg(F.max(F.struct(*ordered)).alias("_latest"))
    return latest.select(*(c if c in key else F.col(f"_latest.{c}").alias(c) for c in observations.columns))
