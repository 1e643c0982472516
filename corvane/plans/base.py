"""What the query modules share: a registry, and the cleaned tables they begin with, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from corvane.operators.retrieval import rank_lists
from corvane.runtime import one_per_key

Tables = Callable[[str], DataFrame]
Query = Callable[[Tables], DataFrame]
POOL, TOP, RRF_K, LEG_K = 20, 5, 4, 30


def registry() -> tuple[dict[str, tuple[Query, str | None]], Callable]:
    found: dict[str, tuple[Query, str | None]] = {}

    def query(sql: str | None = None):
        def add(f: Query) -> Query:
            found[f.__name__] = (f, sql)
            return f

        return add

    return found, query


def legs(t: Tables, k: int = LEG_K) -> DataFrame:
    """The dense and sparse lists of ranked_hit, cut at k."""
    return rank_lists(t("ranked_hit").filter(F.col("leg").isin("dense", "sparse")).select("query_id", "leg", "chunk_id", "score"), k, ["query_id", "leg"])


def cases(t: Tables) -> DataFrame:
    """Evaluation cases with something to find: query_id, split, query_type, required (distinct ids, in order)."""
    case = one_per_key(t("evaluation_case"), "query_id").filter(F.size("required_chunk_ids") > 0)
    return case.select("query_id", "split", "query_type", F.array_distinct("required_chunk_ids").alias("required"))


def articles(t: Tables) -> DataFrame:
    return one_per_key(t("legal_article").drop("recorded_at", "ingested_at"), "article_id")


LEGS = """
h AS (SELECT query_id, leg, chunk_id, max(score) AS score FROM ranked_hit
      WHERE leg IN ('dense', 'sparse') AND score IS NOT NULL AND isfinite(score) AND chunk_id IS NOT NULL GROUP BY 1, 2, 3),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, leg ORDER BY score DESC, chunk_id) AS rank FROM h) WHERE rank <= 30)
"""
FUSED = LEGS + """,
f AS (SELECT query_id, chunk_id, round(sum(1.0 / (4.0 + rank)), 9) AS score FROM l GROUP BY 1, 2),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 20)
"""
CASES = """
c AS (SELECT query_id, split, query_type, list_distinct(required_chunk_ids) AS required FROM (
        SELECT DISTINCT query_id, split, query_type, required_chunk_ids FROM evaluation_case) WHERE len(required_chunk_ids) > 0)
"""
ARTICLES = """
a AS (SELECT DISTINCT ON (article_id) * FROM legal_article)
"""
# Of each case and each pool the rank-ordered hits of required ids.
STAGE = FUSED + "," + CASES + """,
q AS (SELECT query_id, unnest(required) AS chunk_id, len(required) AS n FROM c),
m AS (SELECT q.query_id, any_value(n) AS n, count(*) FILTER (rank <= 5) AS hit5, count(*) FILTER (rank <= 4) AS hit4,
             count(rank) AS hit20, min(rank) AS first FROM q LEFT JOIN p USING (query_id, chunk_id) GROUP BY 1)
"""
