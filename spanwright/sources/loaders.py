"""Loaders of plain text and CSV files, and of blobs of a repository: documents as ``load_markdown`` makes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.text import content_hash, normalize

TEXT_LOADER, CSV_LOADER = "text", "csv"
VERSION = "1.0.0"
_NO_HEADINGS = "array<struct<path:array<string>,level:int,start:int,end:int>>"


def _documents(rows: DataFrame, text: Column, loader: str) -> DataFrame:
    """Rows with ``doc_key`` and ``source_path`` as loaded documents without headings; null texts are left out."""
    loaded = rows.select("doc_key", "source_path", normalize(text).alias("normalized_text")).where("doc_key IS NOT NULL AND normalized_text IS NOT NULL")
    return loaded.select(
        "doc_key",
        "source_path",
        content_hash(F.col("normalized_text")).alias("content_hash"),
        "normalized_text",
        F.array().cast(_NO_HEADINGS).alias("headings"),
        F.lit(loader).alias("loader"),
        F.lit(VERSION).alias("loader_version"),
    )


def _key(path: str) -> Column:
    """A file's path below ``path``, decoded."""
    below = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^[a-z]+:/+", "/")
    root = "/" + path.split("://")[-1].removeprefix("file:").strip("/") + "/"
    return F.when(F.startswith(below, F.lit(root)), F.substr(below, F.lit(len(root) + 1))).otherwise(F.col("_metadata.file_name"))


def load_text(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One document for each text file under ``path``; its key is the path below it. A file has to fit a row."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("wholetext", True).text(path)
    rows = files.select(_key(path).alias("doc_key"), F.col("_metadata.file_path").alias("source_path"), "value")
    return _documents(rows, F.col("value"), TEXT_LOADER)


def load_csv(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """One document for each row of the CSV files under ``path``, which have a header: a line ``name: value`` for each of ``columns``.

    Null values have no line. Rows without ``key`` are left out; keys may repeat.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True).csv(path)
    lines = F.array_compact(F.array(*(F.concat(F.lit(f"{c}: "), F.col(c)) for c in columns)))
    named = rows.select(F.col(key).alias("doc_key"), F.col("_metadata.file_path").alias("source_path"), F.array_join(lines, "\n").alias("t"))
    return _documents(named, F.col("t"), CSV_LOADER)


def documents_at(blobs: DataFrame, sha: str, suffix: str = ".md") -> DataFrame:
    """``(doc_key, raw)`` of one revision of ``blobs(sha, path, bytes)``: paths with the suffix, in the order of their names.

    Bytes that aren't UTF-8 become replacement characters. A path delivered twice counts once, with its greatest content.
    """
    chosen = blobs.where((F.col("sha") == sha) & F.endswith("path", F.lit(suffix)) & F.col("bytes").isNotNull())
    return chosen.groupBy(F.col("path").alias("doc_key")).agg(F.make_valid_utf8(F.max("bytes").cast("string")).alias("raw")).orderBy("doc_key")
