"""Running the study: anchors captured in the snapshots of cohorts, and observed in later ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.operators.anchors import capture, resolve
from spanwright.operators.study import HORIZONS_DAYS, draw_key, eligible_spans, is_auto_generated, stratum
from spanwright.session import materialize

#: Documents that an anchor is drawn from, in each cohort.
DOCUMENTS_PER_COHORT = 50


class UnexpectedPopulation(RuntimeError):
    """The population isn't the one that was registered before the run."""


class SelfComparison(RuntimeError):
    """A cohort would be observed in the snapshot it was captured in."""


def check_population(population: DataFrame, registered: int | None) -> int:
    """The number of rows of the population; raises unless it is the registered one. None registers nothing."""
    n = population.count()
    if registered is not None and n != registered:
        raise UnexpectedPopulation(f"the population has {n} rows, {registered} were registered: the sample would be another one")
    return n


def draw_anchors(cohorts: DataFrame, documents: DataFrame, seed: str, per_cohort: int = DOCUMENTS_PER_COHORT) -> DataFrame:
    """One anchor each for ``per_cohort`` documents drawn in every cohort's snapshot.

    ``cohorts(cohort, snapshot_id)``, ``documents(snapshot_id, doc_key, text, headings)`` with normalized
    texts. Documents that are generated, or have no eligible span, are passed over in the draw. In a drawn
    document one span is drawn. Draws are orders by hash of the seed, so they are the same for every layout.
    ``(cohort, snapshot_id, doc_key, heading_path, span_hash, context_hash, char_range, span_text, stratum)``.
    """
    held = documents.join(cohorts.select("cohort", "snapshot_id").distinct(), "snapshot_id").where(~F.coalesce(is_auto_generated(F.col("text")), F.lit(False)))
    able = held.withColumn("spans", eligible_spans(F.col("text"))).where(F.size("spans") > 0)
    able = materialize(able.select("cohort", "snapshot_id", "doc_key", F.col("spans.span").alias("spans")), "eligible")
    order = Window.partitionBy("cohort").orderBy(draw_key(seed, "cohort", "doc_key"), "doc_key")
    chosen = able.select("cohort", "doc_key").withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_cohort).drop("k")
    offered = able.join(chosen, ["cohort", "doc_key"]).select("cohort", "snapshot_id", "doc_key", F.explode("spans").alias("span"))
    pick = F.min_by("span", F.struct(draw_key(seed, "cohort", "doc_key", "span"), "span"))
    requests = offered.groupBy("cohort", "snapshot_id", "doc_key").agg(pick.alias("span"))
    requests = requests.select(F.col("cohort").alias("request_id"), F.col("snapshot_id").alias("source"), "doc_key", "span", F.lit(0).alias("occurrence"))
    anchors, _ = capture(requests, documents.withColumnRenamed("snapshot_id", "source"))
    return anchors.withColumnsRenamed({"request_id": "cohort", "source": "snapshot_id"}).withColumn("stratum", stratum(F.col("span_text")))


def targets(cohorts: DataFrame, headers: DataFrame, horizons=HORIZONS_DAYS) -> DataFrame:
    """``(cohort, snapshot_id, offset_days, observed_id)``: the newest snapshot of the source at each horizon.

    ``cohorts(cohort, snapshot_id, source, captured_at)``, ``headers(snapshot_id, source, captured_at)``. Horizons
    beyond the newest header can't be reached and are left out.
    """
    asked = cohorts.select("cohort", F.col("snapshot_id").alias("base"), "source", "captured_at", F.explode(F.array(*map(F.lit, horizons))).alias("offset_days"))
    asked = asked.withColumn("until", F.col("captured_at") + F.make_dt_interval(F.col("offset_days"))).drop("captured_at")
    seen = headers.select("source", "captured_at", F.col("snapshot_id").alias("later_id"))
    asked = asked.join(seen.agg(F.max("captured_at").alias("end"))).where("until <= end")
    newest = F.max(F.struct("captured_at", "later_id"))["later_id"].alias("observed_id")
    return asked.join(seen, "source").where("captured_at <= until").groupBy("cohort", F.col("base").alias("snapshot_id"), "offset_days").agg(newest)


def observe(anchors: DataFrame, targets: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every cohort's anchors resolved at each of its targets: ``(observations, unresolvable)``.

    ``anchors`` as from ``draw_anchors``, ``documents(snapshot_id, doc_key, text, headings)``. Raises
    ``SelfComparison`` if a target is the cohort's own snapshot: nothing could have changed, and the outcome
    would be made up. ``observations``: ``(cohort, span_hash, doc_key, stratum, offset_days, observed_id, resolution)``.
    """
    own = targets.where("snapshot_id = observed_id").select("cohort", "offset_days").limit(1).collect()
    if own:
        raise SelfComparison(f"cohort {own[0]['cohort']} at {own[0]['offset_days']} days would be compared with itself")
    asked = anchors.join(targets.select("cohort", "offset_days", "observed_id"), "cohort")
    key = F.sha2(F.concat_ws("|", "cohort", "span_hash", "doc_key", "offset_days"), 256).alias("anchor_ord")
    asked = materialize(asked.select(key, "*").withColumn("source", F.col("observed_id")), "asked")
    resolutions, unresolvable = resolve(asked, documents.join(targets.select(F.col("observed_id").alias("snapshot_id")).distinct(), "snapshot_id", "left_semi").withColumnRenamed("snapshot_id", "source"))
    about = asked.select("anchor_ord", "cohort", "span_hash", "doc_key", "stratum", "offset_days", "observed_id")
    return (
        about.join(resolutions.select("anchor_ord", "resolution"), "anchor_ord").drop("anchor_ord"),
        about.join(unresolvable, "anchor_ord").select("cohort", "span_hash", "offset_days", "reason"),
    )


def with_anchor_metadata(observations: DataFrame, anchors: DataFrame) -> DataFrame:
    """Observations with what is known of their anchor, by ``(cohort, span_hash)``: its ``doc_key`` and ``stratum``.

    Anchors delivered more than once count once, with their greatest values; an observation of an unknown
    anchor keeps nulls. Columns of these names in ``observations`` are replaced.
    """
    known = anchors.groupBy("cohort", "span_hash").agg(F.max("doc_key").alias("doc_key"), F.max("stratum").alias("stratum"))
    return observations.drop("doc_key", "stratum").join(known, ["cohort", "span_hash"], "left")
