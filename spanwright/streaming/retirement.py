"""The retirement rule over a stream of observations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from spanwright.operators.policy import CONSECUTIVE_DESTROYED, MIN_ELAPSED_DAYS

OUTPUT = "cohort int, span_hash string, n_run bigint, elapsed_days double, propose boolean"
STATE = "seq bigint, n_run bigint, first_us bigint, last_us bigint"


def retirement_stream(observations: DataFrame, consecutive: int = CONSECUTIVE_DESTROYED, min_days: float = MIN_ELAPSED_DAYS) -> DataFrame:
    """The current state of each anchor's trailing run, after every batch that brings news of it.

    ``observations(cohort, span_hash, seq, observed_at, resolution)``. The state of an anchor is four
    numbers; a row whose ``seq`` isn't beyond the last one seen is a repeated delivery and is skipped, so
    within an anchor the stream must be in order from batch to batch. Rows without key, seq or time are
    left out. Write it in update mode.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, run, first, last = state.get if state.exists else (-(1 << 62), 0, 0, 0)
        for pdf in sorted((row for b in batches for row in b[["seq", "at", "resolution"]].itertuples(index=False)), key=lambda r: r.seq):
            if pdf.seq <= seq:
                continue
            seq = int(pdf.seq)
            if pdf.resolution == "destroyed":
                first, last, run = (int(pdf.at) if run == 0 else first), int(pdf.at), run + 1
            else:
                run = 0
        state.update((seq, run, first, last))
        days = (last - first) / 86_400_000_000 if run else None
        propose = bool(run >= max(1, consecutive) and days is not None and days >= min_days)
        yield pd.DataFrame({"cohort": [key[0]], "span_hash": [key[1]], "n_run": [run], "elapsed_days": [days], "propose": [propose]})

    from pyspark.sql import functions as F

    rows = observations.select("cohort", "span_hash", "seq", F.unix_micros("observed_at").alias("at"), "resolution").dropna(
        subset=["cohort", "span_hash", "seq", "at"]
    )
    return rows.groupBy("cohort", "span_hash").applyInPandasWithState(advance, OUTPUT, STATE, "update", "NoTimeout")
