"""Queries of the overlap of questions across splits."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.text import canonical_label
from spanwright.llm.question_overlap import question_overlaps
from spanwright.session import read_table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train candidates that ask a test's question."""
    tests = read_table(spark, sf_dir, "test_cases", ["test_id", "question"])
    train = read_table(spark, sf_dir, "candidates").where(canonical_label(F.col("split")) == "train").select("candidate_id", "question")
    return question_overlaps(tests, train)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps by evaluation split and candidate source."""
    found = p5_found(spark, sf_dir)
    kinds = read_table(spark, sf_dir, "benchmarks", ["benchmark_id", "kind"]).distinct()
    tests = read_table(spark, sf_dir, "test_cases", ["test_id", "benchmark_id"]).distinct().join(kinds, "benchmark_id", "left")
    sources = read_table(spark, sf_dir, "candidates", ["candidate_id", "source"]).distinct()
    return (
        found.join(tests, "test_id")
        .join(sources, "candidate_id")
        .groupBy(F.col("kind").alias("split"), "source")
        .agg(
            F.count_distinct("candidate_id", "test_id").alias("n_overlaps"),
            F.count_distinct("test_id").alias("n_tests"),
            F.count_distinct("candidate_id").alias("n_candidates"),
        )
    )


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
# A plainer measure over all pairs with the same numbers and codes: the share of word pairs, unweighted.
_PAIRS = r"""WITH asked AS (
  SELECT DISTINCT 't' AS side, test_id AS id, nfc_normalize(question) AS q FROM test_cases WHERE test_id IS NOT NULL AND question IS NOT NULL
  UNION ALL SELECT DISTINCT 'c', candidate_id, nfc_normalize(question) FROM candidates WHERE candidate_id IS NOT NULL AND question IS NOT NULL AND lower(trim(split)) = 'train'
), spelled AS (SELECT *, regexp_extract_all(q, '[\p{L}\p{N}_=]+(?:[.:][\p{L}\p{N}_=]+)*') AS s, q <> lower(q) AND q <> upper(q) AS mixed FROM asked
), parsed AS (
  SELECT side, id, w, list_sort(list_distinct(list_filter(w, lambda x: regexp_matches(x, '[\p{N}_=:.]')))) AS exact, list_distinct(list_zip(w[:-2], w[2:])) AS pairs,
    CASE WHEN mixed THEN list_transform(list_filter(s[2:], lambda x: regexp_matches(x, '^\p{Lu}') AND NOT regexp_matches(x, '[\p{N}_=:.]')), lambda x: lower(x)) ELSE [] END AS names
  FROM (SELECT *, list_transform(s, lambda x: lower(x)) AS w FROM spelled) WHERE len(s) > 0
), found AS (
  SELECT DISTINCT c.id AS candidate_id, t.id AS test_id FROM parsed t JOIN parsed c ON t.side = 't' AND c.side = 'c' AND t.exact = c.exact
  WHERE len(list_intersect(t.pairs, c.pairs)) >= 0.4 * len(list_distinct(list_concat(t.pairs, c.pairs))) AND list_has_all(c.w, t.names)
)"""

ORACLES = {
    "p5_found": _PAIRS + " SELECT candidate_id, test_id FROM found",
    "p5_report": _PAIRS
    + """ SELECT kind AS split, source, count(DISTINCT (candidate_id, test_id)) AS n_overlaps, count(DISTINCT test_id) AS n_tests, count(DISTINCT candidate_id) AS n_candidates
FROM found JOIN (SELECT DISTINCT test_id, benchmark_id FROM test_cases) USING (test_id) LEFT JOIN (SELECT DISTINCT benchmark_id, kind FROM benchmarks) USING (benchmark_id)
JOIN (SELECT DISTINCT candidate_id, source FROM candidates) USING (candidate_id) GROUP BY ALL""",
}
