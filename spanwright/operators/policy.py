"""What to do about an observation, and whether an anchor's history speaks for retiring it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The action for each outcome. None of them retires an anchor.
ACTIONS = {
    "valid": "none",
    "valid_repaired": "repair",
    "valid_relocated": "repair_and_note",
    "stale": "review",
    "ambiguous": "review",
    "destroyed": "watch",
}
CONSECUTIVE_DESTROYED = 3
MIN_ELAPSED_DAYS = 14


def action_for(resolution: Column) -> Column:
    """The action for an outcome; null for anything that is none."""
    return F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))[resolution]


def needs_human(resolution: Column) -> Column:
    """Whether a person has to look: stale or ambiguous."""
    return F.coalesce(resolution.isin("stale", "ambiguous"), F.lit(False))


def retirement(
    history: DataFrame, keys: list[str], consecutive: int = CONSECUTIVE_DESTROYED, min_days: float = MIN_ELAPSED_DAYS
) -> DataFrame:
    """For each anchor of ``history(*keys, seq, observed_at, resolution)``: ``(*keys, n_run, elapsed_days, propose)``.

    Looks at the destroyed observations at the end of an anchor's history, in order of ``seq`` (unique for an
    anchor). Retirement is proposed if they are at least ``consecutive``, one at least, and at least
    ``min_days`` lie between the first and the last of them. A null outcome breaks the run; a null time
    leaves the elapsed time unknown and proposes nothing.
    """
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    gone = F.coalesce(F.col("resolution") == "destroyed", F.lit(False))
    run = history.withColumn("_breaks", F.sum(F.when(gone, 0).otherwise(1)).over(newest_first)).withColumn("_in_run", F.col("_breaks") == 0)
    at = F.when(F.col("_in_run"), F.col("observed_at"))
    sequence = F.when(F.col("_in_run"), F.col("seq"))
    out = run.groupBy(*keys).agg(
        F.count_if("_in_run").alias("n_run"),
        F.max_by(at, sequence).alias("_last"),
        F.min_by(at, sequence).alias("_first"),
    )
    days = (F.unix_micros("_last") - F.unix_micros("_first")) / F.lit(86_400_000_000)
    enough = (F.col("n_run") >= max(1, consecutive)) & F.coalesce(days >= min_days, F.lit(False))
    return out.select(*keys, "n_run", days.alias("elapsed_days"), enough.alias("propose"))


def may_retire(proposals: DataFrame, confirmed_by: Column) -> DataFrame:
    """Adds ``may_retire``: proposed, and confirmed by someone with a name."""
    return proposals.withColumn("may_retire", F.col("propose") & (F.coalesce(confirmed_by, F.lit("")) != ""))
