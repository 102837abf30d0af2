"""Queries of the reading levels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm.reading_level import reading_levels
from spanwright.session import read_table


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and band of every document."""
    levels = reading_levels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "reading_grades"))
    return levels.withColumn("level", F.round("level", 4))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at the easy or at the hard end."""
    levels = reading_levels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "reading_grades"))
    return levels.where(F.col("band").isin("easy", "hard")).select("doc_id", "band").distinct()


def p8_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of the sources: documents of each band."""
    levels = p8_levels(spark, sf_dir).select("doc_id", "band")
    sources = read_table(spark, sf_dir, "documents", ["doc_id", "source"])
    return levels.join(sources, "doc_id").groupBy("source", "band").agg(F.count("*").alias("n_documents"))


QUERIES = {"p8_found": p8_found, "p8_levels": p8_levels, "p8_by_source": p8_by_source}
ORACLES: dict[str, str] = {}
