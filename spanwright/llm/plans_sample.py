"""Query of the stable sample."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm.stable_sample import RATE_BITS, ROUNDS, stable_sample
from spanwright.plans import sqltext
from spanwright.session import read_table

RATE = 0.1
SEED = "spanwright"


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the anchors with all their observations."""
    sample = stable_sample(read_table(spark, sf_dir, "observations"), RATE, SEED)
    return sample.withColumn("written_at", F.unix_micros("written_at"))


def _signed(hex_digits: str) -> str:
    u = f"('0x' || {hex_digits})::UBIGINT::HUGEINT"
    return f"({u} - CASE WHEN {u} > 9223372036854775807 THEN 18446744073709551616 ELSE 0 END)::BIGINT"


def _sample_sql() -> str:
    ctes = [
        f"""tidy AS (
  SELECT * REPLACE ({sqltext.canonical_sha256("span_hash")} AS span_hash, {sqltext.canonical_label("resolution")} AS resolution,
                    lower({sqltext.strip("stratum")}) AS stratum, lower({sqltext.strip("record")}) AS record)
  FROM observations)""",
        # the one document known for an observation
        """owned AS (SELECT * REPLACE (coalesce(doc_key, CASE WHEN max(doc_key) OVER place = min(doc_key) OVER place THEN max(doc_key) OVER place END) AS doc_key)
  FROM tidy WINDOW place AS (PARTITION BY cohort, span_hash, offset_days, observed_sha))""",
        f"""f0 AS (SELECT *, {_signed("substr(span_hash, 1, 16)")} AS l0, {_signed("substr(span_hash, 17, 16)")} AS l1,
  {_signed("substr(span_hash, 33, 16)")} AS r0, {_signed("substr(span_hash, 49, 16)")} AS r1
  FROM owned WHERE cohort IS NOT NULL AND span_hash IS NOT NULL)""",
    ]
    for n in range(ROUNDS):
        ctes.append(
            f"""f{n + 1} AS (SELECT * EXCLUDE (h) REPLACE (r0 AS l0, r1 AS l1, xor(l0, {_signed("substr(h, 1, 16)")}) AS r0,
  xor(l1, {_signed("substr(h, 17, 16)")}) AS r1)
  FROM (SELECT *, md5('{SEED}|{n}|' || cohort || '|' || r0 || '|' || r1) AS h FROM f{n}))"""
        )
    unsigned = "(r0::HUGEINT + CASE WHEN r0 < 0 THEN 18446744073709551616 ELSE 0 END)"
    return (
        "WITH "
        + ", ".join(ctes)
        + f"""
SELECT * EXCLUDE (l0, l1, r0, r1, written_at), epoch_us(written_at) AS written_at FROM f{ROUNDS}
WHERE {unsigned} // {1 << (64 - RATE_BITS)} < {int(RATE * (1 << RATE_BITS))}
QUALIFY row_number() OVER (PARTITION BY cohort, span_hash, offset_days, observed_sha, doc_key ORDER BY batch DESC NULLS LAST,
  written_at DESC NULLS LAST, record DESC NULLS LAST, quarter DESC NULLS LAST, cohort_sha DESC NULLS LAST,
  cohort_date DESC NULLS LAST, churn_90d DESC NULLS LAST, stratum DESC NULLS LAST,
  resolution DESC NULLS LAST) = 1"""
    )


QUERIES = {"p1_sample": p1_sample}
ORACLES = {"p1_sample": _sample_sql()}
