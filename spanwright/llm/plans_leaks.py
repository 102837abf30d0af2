"""Queries of the leak search."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm.leaks import passage_leaks
from spanwright.session import read_table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out passages and the documents that hold them."""
    return passage_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "heldout_passages"))


def p7_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking documents and leaked passages of each source and benchmark."""
    documents, passages = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "heldout_passages")
    leaks = passage_leaks(documents, passages)
    benchmarks = passages.select("item_id", "benchmark_id").distinct()
    return (
        leaks.join(documents.select("doc_id", "source").distinct(), "doc_id")
        .join(benchmarks, "item_id")
        .groupBy("source", "benchmark_id")
        .agg(F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("item_id").alias("n_passages"))
    )


QUERIES = {"p7_found": p7_found, "p7_by_source": p7_by_source}
# A plainer measure over all passages and documents: of the 28 word triples of some 30 words in a row of a passage, or of all of a
# shorter one, so many stand anywhere in the document. On the tables nothing lies between 22 (scattered phrases) and 25.
_LEAKS = r"""WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT DISTINCT 'p', item_id, text FROM heldout_passages WHERE item_id IS NOT NULL AND text IS NOT NULL
), plain AS (SELECT side, id, regexp_replace(regexp_replace(regexp_replace(text, '-\r?\n[ \t]*', '', 'g'), '(?m)^[ \t>]*([-*+]|\d{1,3}[.)])[ \t]+', '', 'g'), '<[A-Za-z/!][^<>\n]*>', ' ', 'g') AS t FROM texts
), words AS (SELECT side, id, regexp_extract_all(lower(strip_accents(t)), '[\p{L}\p{N}]+') AS w FROM plain
), triples AS (SELECT side, id, len(w) - 2 AS n, unnest(range(1, len(w) - 1)) AS k, unnest(list_zip(w[:-3], w[2:-2], w[3:])) AS g FROM words
), hits AS (SELECT DISTINCT p.id AS item_id, d.id AS doc_id, p.k, p.n FROM triples p JOIN triples d ON p.g = d.g AND p.side = 'p' AND d.side = 'd'
), runs AS (SELECT item_id, doc_id, n, count(*) OVER (PARTITION BY item_id, doc_id ORDER BY k RANGE BETWEEN CURRENT ROW AND 27 FOLLOWING) AS c FROM hits
), found AS (SELECT DISTINCT item_id, doc_id FROM runs WHERE c >= 0.85 * least(n, 28))"""

ORACLES = {
    "p7_found": _LEAKS + " SELECT item_id, doc_id FROM found",
    "p7_by_source": _LEAKS
    + """ SELECT source, benchmark_id, count(DISTINCT doc_id) AS n_documents, count(DISTINCT item_id) AS n_passages FROM found
JOIN (SELECT DISTINCT doc_id, source FROM documents) USING (doc_id) JOIN (SELECT DISTINCT item_id, benchmark_id FROM heldout_passages) USING (item_id) GROUP BY ALL""",
}
