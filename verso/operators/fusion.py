"""Reciprocal rank fusion and merging of sub-queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verso.operators import lexical, vector
from verso.operators.index import KeywordIndex


def fuse(vectors: DataFrame, keywords: DataFrame, k: int = 60, limit: int = 10) -> DataFrame:
    """A full outer join of two rankings; ties go to the better vector rank, then keyword rank."""
    both = vectors.join(keywords, ["query_id", "chunk_id"], "full_outer")

    def part(c: str):
        return F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))

    both = both.withColumn("rrf_score", F.round(part("vector_rank") + part("bm25_rank"), 6))
    order = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"), "chunk_id")
    return both.withColumn("fusion_rank", F.row_number().over(order)).filter(F.col("fusion_rank") <= limit)


def merge_subqueries(found: DataFrame, score: str, cap: int = 15) -> DataFrame:
    """The best row of each chunk over sub-queries (``sub_id``), the first of equals, then the best ``cap``."""
    best = W.partitionBy("query_id", "chunk_id").orderBy(F.desc(score), "sub_id")
    one = found.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return lexical.top(one, cap, score, "merged_rank")


def retrieve(strategy: str, chunks: DataFrame, questions: DataFrame, k: int = 10, pool: int = 20, keep: Column | None = None, index: KeywordIndex | None = None) -> DataFrame:
    """``vector`` or ``hybrid`` retrieval of ``questions`` (``query_id, question, query_vector``).

    ``keep`` filters chunks in both rankings, and so does the access of users
    (``user_department, is_admin``) where questions carry it. Keywords come
    from a stored ``index`` if one is given.
    """
    queries = questions.filter("query_vector is not null")
    if strategy == "vector":
        return vector.search(chunks.filter("embedding is not null"), queries, k, keep)
    if strategy == "hybrid":
        words = lexical.search(chunks, questions, pool, keep) if index is None else index.search(questions, pool, keep)
        return fuse(vector.search(chunks.filter("embedding is not null"), queries, pool, keep), words, limit=k)
    raise ValueError(f"unknown retrieval strategy: {strategy}")
