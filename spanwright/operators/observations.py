"""Observations as delivered, made ready for analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import canonical_label, canonical_sha256


def distinct_observations(observations: DataFrame) -> DataFrame:
    """One row for each ``(cohort, span_hash, offset_days)``: ``(..., stratum, churn_90d, cohort_date, resolution)``.

    Hashes, outcomes and strata get their one spelling; of rows delivered again the latest batch counts, then
    the latest time, then the greatest values. Rows without one of the keys are left out.
    """
    tidy = observations.select(
        "cohort",
        canonical_sha256(F.col("span_hash")).alias("span_hash"),
        "offset_days",
        F.struct(
            "batch",
            "written_at",
            canonical_label(F.col("resolution")).alias("resolution"),
            canonical_label(F.col("stratum")).alias("stratum"),
            "churn_90d",
            "cohort_date",
        ).alias("o"),
    ).dropna(subset=["cohort", "span_hash", "offset_days"])
    latest = tidy.groupBy("cohort", "span_hash", "offset_days").agg(F.max("o").alias("o"))
    return latest.select("cohort", "span_hash", "offset_days", "o.resolution", "o.stratum", "o.churn_90d", "o.cohort_date")
