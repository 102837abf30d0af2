"""Sampling spans, observing them over time, and estimating how long they last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.markdown import fenced_regions, parse_headings
from spanwright.functions.text import WS, normalize, py_strip, technical_tokens
from spanwright.session import materialize

# Fixed values of the study.
MIN_SPAN, MAX_SPAN = 40, 400
HORIZONS_DAYS = (7, 14, 30, 60, 90, 180, 365)
FOUND = ("valid", "valid_repaired", "valid_relocated")


def stratum(span: Column) -> Column:
    """numeric if there is any digit, identifier if there is a technical token, else prose."""
    return F.when(span.rlike(r"\p{Nd}"), "numeric").when(F.size(technical_tokens(span)) > 0, "identifier").when(span.isNotNull(), "prose")


def is_auto_generated(raw: Column) -> Column:
    """Whether front matter says ``auto_generated: true``."""
    return F.contains(F.regexp_extract(raw, r"(?s)\A---\n(.*?)\n---\n", 1), F.lit("auto_generated: true"))


def eligible_spans(text: Column) -> Column:
    """Sentences of 40 to 400 characters that stand once in a text, under a heading and outside of code.

    ``array<struct<span, start>>`` of a normalized text, in order; empty without headings.
    """
    pieces = F.transform(F.split(text, rf"(?<=[.!?])[{WS}]+", -1), py_strip)
    sized = F.filter(pieces, lambda p: F.char_length(p).between(MIN_SPAN, MAX_SPAN))
    placed = F.transform(sized, lambda p: F.struct(p.alias("span"), F.call_function("locate", p, text, F.lit(1)).alias("at")))
    once = F.filter(placed, lambda p: (p["at"] > 0) & (F.call_function("locate", p["span"], text, p["at"] + 1) == 0))
    single = F.transform(once, lambda p: F.struct(p["span"].alias("span"), (p["at"] - 1).alias("start")))
    bound = F.get(
        F.transform(
            F.array(F.struct(parse_headings(text).alias("h"), fenced_regions(text).alias("f"))),
            lambda m: F.filter(
                single,
                lambda s: F.exists(m["h"], lambda h: (h["start"] <= s["start"]) & (s["start"] < h["end"]))
                & ~F.exists(m["f"], lambda f: (f["start"] <= s["start"]) & (s["start"] < f["end"])),
            ),
        ),
        F.lit(0),
    )
    return bound


def quarter_of(ts: Column) -> Column:
    """``YYYYQn`` of a time in the session's zone."""
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def draw_key(seed: str, *columns: str) -> Column:
    """A reproducible random order that other engines can compute too: MD5 of seed and values."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def draw(df: DataFrame, by: list[str], identity: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each group, drawn by hash: the same for any order and layout. Null identities aren't drawn."""
    order = Window.partitionBy(*by).orderBy(draw_key(seed, identity), identity)
    return df.where(F.col(identity).isNotNull()).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def as_of(left: DataFrame, left_time: str, right: DataFrame, right_time: str, right_order: str) -> DataFrame:
    """Each left row with the newest right row at or before its time; ties go to the greatest ``right_order``.

    Linear, without a join by range: of the right rows one is kept for each time, and these and the distinct
    times of the left are ranged by time into partitions of like size, however unevenly they lie. In a partition each
    time takes the last right row above it; a time with none there takes the newest of the partitions before. Left rows without
    time, or before any right row, get nulls. Right columns that are named like left ones get the prefix ``right_``.
    """
    names = right.columns
    row = F.struct(F.col(right_order).alias("_o"), *names)
    r = right.where(F.col(right_time).isNotNull()).groupBy(F.col(right_time).alias("_time")).agg(F.max(row).alias("r")).withColumn("_asks", F.lit(0))
    asked = left.where(F.col(left_time).isNotNull()).select(F.col(left_time).alias("_time")).distinct()
    both = r.unionByName(asked.withColumn("_asks", F.lit(1)), allowMissingColumns=True).repartitionByRange("_time")
    both = materialize(both.withColumn("_part", F.spark_partition_id()), "as-of")
    above = Window.partitionBy("_part").orderBy("_time", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_own", F.last("r", ignorenulls=True).over(above)).where("_asks = 1").select("_time", "_part", "_own")
    newest = both.groupBy("_part").agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.col("_time"))).alias("_newest"))
    # one row for each partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = newest.select("_part", F.last("_newest", ignorenulls=True).over(earlier).alias("_before"))
    found = inside.join(before, "_part").select("_time", F.coalesce("_own", "_before").alias("r"))
    out = left.join(found, F.col(left_time) == F.col("_time"), "left")
    return out.select(*left.columns, *(F.col(f"r.{c}").alias(f"right_{c}" if c in left.columns else c) for c in names))


def trailing_counts(events: DataFrame, time: str, days: int = 90) -> DataFrame:
    """For each distinct day of ``events``: how many events lie on it and the ``days`` before: ``(day, n_day, n_trailing)``.

    Days are counted first, so the window runs over days, not events.
    """
    daily = events.where(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n_day"))
    window = Window.orderBy(F.unix_date("day")).rangeBetween(-days, 0)
    return daily.select("day", "n_day", F.sum("n_day").over(window).alias("n_trailing"))


def reachable_horizons(cohorts: DataFrame, analysis_date: str, horizons=HORIZONS_DAYS) -> DataFrame:
    """Of ``cohorts(cohort_date)``, how many can be observed at each horizon: ``(offset_days, n, observable, censored)``."""
    start = F.to_date("cohort_date")
    rows = cohorts.select(start.alias("d"), F.explode(F.array(*(F.lit(h) for h in horizons))).alias("offset_days"))
    seen = F.coalesce(F.date_add("d", F.col("offset_days")) <= F.lit(analysis_date).cast("date"), F.lit(False))
    out = rows.groupBy("offset_days").agg(F.count("*").alias("n"), F.count_if(seen).alias("observable"))
    return out.withColumn("censored", 1 - F.col("observable") / F.col("n"))


def upper_medians(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """``(*by, median)``: the middle value of each group, of an even number the upper one. Nulls don't count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy(column)
    total = F.sum("_n").over(Window.partitionBy(*by))
    upto = F.sum("_n").over(order)
    placed = counts.select(*by, column, F.floor(total / 2).alias("_middle"), upto.alias("_upto"))
    return placed.where(F.col("_upto") > F.col("_middle")).groupBy(*by).agg(F.min(column).alias("median"))


def first_events(observations: DataFrame, event: str, key: tuple[str, ...] = ("cohort", "span_hash")) -> DataFrame:
    """Survival input, one row for each anchor: ``(*key, stratum, churn_90d, time, event)``.

    The time is the first offset at which the outcome is ``event``, else the last offset, censored. Stratum
    and churn are those of the earliest observation that has them. Rows without key or offset don't count.
    """
    rows = observations.dropna(subset=[*key, "offset_days"])
    hit = F.min(F.when(F.col("resolution") == event, F.col("offset_days")))
    earliest = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("offset_days", c)))[c].alias(c)
    out = rows.groupBy(*key).agg(hit.alias("_hit"), F.max("offset_days").alias("_last"), earliest("stratum"), earliest("churn_90d"))
    return out.select(*key, "stratum", "churn_90d", F.coalesce("_hit", "_last").cast("double").alias("time"), F.col("_hit").isNotNull().alias("event"))


def kaplan_meier(observations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(*by, time, at_risk, events, survival)`` at each time with an event, from ``(*by, time, event)``.

    At risk are all with at least that time. Survival is a product, not a sum of logarithms, so it may be 0.
    Only distinct times are sorted. Null times don't count, a null event is none.
    """
    by = by or []
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    tally = (
        observations.where(F.col("time").isNotNull())
        .groupBy(*by, "time")
        .agg(F.count("*").alias("n"), F.count_if(F.coalesce("event", F.lit(False))).alias("events"))
    )
    at_risk = F.sum("n").over(part.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0))
    hits = tally.withColumn("at_risk", at_risk).where("events > 0")
    alive = F.product(1 - F.col("events") / F.col("at_risk")).over(part.orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    return hits.select(*by, "time", "at_risk", "events", alive.alias("survival"))


def median_survival(curve: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, median)``: the first time with survival of a half or less; null if there is none."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"))


def survival_at(curve: DataFrame, groups: DataFrame, by: list[str], horizons=HORIZONS_DAYS) -> DataFrame:
    """``(*by, horizon, survival)`` for every group of ``groups(*by)``: the curve's last value up to then, 1 before the first event."""
    asked = groups.select(*by).distinct().withColumn("horizon", F.explode(F.array(*(F.lit(float(h)) for h in horizons))))
    steps = curve.groupBy(*by).agg(F.collect_list(F.struct("time", "survival")).alias("steps"))
    joined = asked.join(steps, by, "left") if by else asked.crossJoin(F.broadcast(steps))  # one row
    last = F.array_max(F.filter("steps", lambda s: s["time"] <= F.col("horizon")))
    return joined.select(*by, "horizon", F.coalesce(last["survival"], F.lit(1.0)).alias("survival"))


def resolution_histogram(observations: DataFrame) -> DataFrame:
    """``(resolution, n, percent)``; null outcomes don't count."""
    counts = observations.where("resolution IS NOT NULL").groupBy("resolution").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def churn_split(first: DataFrame) -> DataFrame:
    """Survival input with ``churn``: high above the upper median of all anchors' churn, else low. Anchors without churn are left out."""
    known = first.where("churn_90d IS NOT NULL")
    median = upper_medians(known.withColumn("_all", F.lit(0)), ["_all"], "churn_90d").select(F.col("median").alias("_median"))
    # one row, or none for an empty table
    split = known.join(F.broadcast(median), F.lit(True))
    return split.withColumn("churn", F.when(F.col("churn_90d") > F.col("_median"), "high").otherwise("low")).drop("_median")


def destroyed_recovery(observations: DataFrame, key: tuple[str, ...] = ("cohort", "span_hash")) -> DataFrame:
    """Anchors that were ever destroyed, and how many of them were found again at a later offset: ``(ever_destroyed, recovered)``."""
    rows = observations.dropna(subset=[*key, "offset_days"])
    span = rows.groupBy(*key).agg(
        F.min(F.when(F.col("resolution") == "destroyed", F.col("offset_days"))).alias("lost"),
        F.max(F.when(F.col("resolution").isin(*FOUND), F.col("offset_days"))).alias("last_found"),
    )
    return span.where("lost IS NOT NULL").agg(F.count("*").alias("ever_destroyed"), F.count_if(F.col("last_found") > F.col("lost")).alias("recovered"))
