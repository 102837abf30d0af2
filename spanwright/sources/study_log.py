"""The study's append-only JSON lines: one header, observations, and anchors that couldn't be resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATION = (
    "record string, cohort int, quarter string, cohort_sha string, cohort_date string, churn_90d int, span_hash string, "
    "doc_key string, stratum string, offset_days int, observed_sha string, resolution string"
)
HEADER = "record string, corpus_head string, analysis_date string, seed int, cohorts int, offsets_days array<int>"
UNRESOLVABLE = "record string, cohort int, span_hash string, offset_days int, reason string"
KINDS = {"run_header": HEADER, "observation": OBSERVATION, "unresolvable": UNRESOLVABLE}
REASON_CHARACTERS = 200


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of one kind; blank lines are skipped, unreadable ones fail."""
    return spark.read.schema(KINDS[kind]).option("mode", "FAILFAST").json(path).where(F.col("record") == kind)


def last_header(spark: SparkSession, path: str) -> DataFrame:
    """The header written last; a log that was continued has several. No row without any."""
    rows = spark.read.schema(HEADER).option("mode", "FAILFAST").json(path).where("record = 'run_header'")
    order = [F.desc(c) for c in ("_metadata.file_modification_time", "_metadata.file_name")]
    return rows.withColumn("_n", F.monotonically_increasing_id()).orderBy(*order, F.desc("_n")).drop("_n").limit(1)


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """One JSON object with a list of rows for each part, in one file. Parts are results of aggregation, so few rows."""
    spark = next(iter(parts.values())).sparkSession
    whole = spark.range(1)
    for name, df in parts.items():
        whole = whole.crossJoin(df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)))
    whole.drop("id").coalesce(1).write.mode("overwrite").json(path)


def report_lines(parts: dict[str, DataFrame]) -> DataFrame:
    """The same as text: ``(part, line)``, a title line for each part and one line ``column value ...`` for each row."""
    out = None
    for name, df in parts.items():
        values = F.concat_ws("  ", *(F.concat(F.lit(f"{c} "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns))
        lines = df.select(F.lit(name).alias("part"), F.lit(1).alias("k"), values.alias("line"))
        title = df.sparkSession.range(1).select(F.lit(name).alias("part"), F.lit(0).alias("k"), F.lit(f"== {name}").alias("line"))
        part = title.unionByName(lines)
        out = part if out is None else out.unionByName(part)
    return out.orderBy("part", "k", "line").select("part", "line")


def append_log(df: DataFrame, path: str, kind: str) -> None:
    """Append records of one kind; reasons are cut to 200 characters, as the format says."""
    columns = [part.split()[0] for part in KINDS[kind].split(", ")]
    out = df.withColumn("record", F.lit(kind))
    if kind == "unresolvable":
        out = out.withColumn("reason", F.substring("reason", 1, REASON_CHARACTERS))
    out.select(*columns).write.mode("append").json(path)
