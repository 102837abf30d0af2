"""Queries of the packing operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm.packing import CAPACITY, pack_texts
from spanwright.session import materialize, read_table


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in containers of 2,048 tokens."""
    return pack_texts(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: number by fill, in steps of a hundredth."""
    used = p6_pack(spark, sf_dir).where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    step = F.floor(F.col("used") * 100 / CAPACITY).cast("int").alias("fill_percent")
    return used.groupBy(step).agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"))


def p6_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text, whether its pieces cover it without gaps, whether it was cut without need, and whether a container of its is too full."""
    packed = materialize(p6_pack(spark, sf_dir), "packed-texts")
    used = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    placed = packed.join(used, "container_id", "left")
    n, last = F.sum("n_tokens"), F.max(F.col("start_token") + F.col("n_tokens"))
    return placed.groupBy("doc_id").agg(
        (n == 0).alias("empty"), (n == last).alias("covered"), ((F.count("*") > 1) & (n <= CAPACITY)).alias("cut"), F.coalesce(F.max("used") > CAPACITY, F.lit(False)).alias("overfull")
    )


QUERIES = {"p6_pack": p6_pack, "p6_fill": p6_fill, "p6_audit": p6_audit}
ORACLES = {"p6_audit": "SELECT doc_id, coalesce(text, '') = '' AS empty, true AS covered, false AS cut, false AS overfull FROM documents"}
