"""Fusion, reranking and search over ranked lists (query_id, rank, doc, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import squeeze, strip, tokens

RRF_K = 60


def clamp(n: int, least: int, most: int) -> int:
    return max(least, min(n, most))


def rrf_fuse(lists: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: query_id, rank, doc, score.

    A doc that occurs twice in a list counts twice. Ties go to the one seen first: by the list it
    is first in, then by its rank there.
    """
    every = None
    for i, one in enumerate(lists):
        x = one.select("query_id", "doc", F.lit(i).alias("list"), "rank")
        every = x if every is None else every.unionByName(x)
    assert every is not None
    fused = every.groupBy("query_id", "doc").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.list", "first.rank")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc", "score")


def lexical_score(query, content):  # noqa: ANN001, ANN201
    """Stand-in of a cross-encoder: the share of the query's distinct tokens that the text holds."""
    q, c = F.array_distinct(tokens(query)), F.array_distinct(tokens(content))
    return F.round(F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q)), 6)


def rerank(candidates: DataFrame, k: int, score=None) -> DataFrame:  # noqa: ANN001
    """query_id, rank, doc, score, rerank_score: candidates (with text and content) ordered by the
    pair score, unscored ones last, ties in the order they came. A blank query keeps its order."""
    s = score(F.col("text"), F.col("content")) if score else lexical_score(F.col("text"), F.col("content"))
    c = candidates.withColumn("rerank_score", F.when(strip(F.coalesce("text", F.lit(""))) != "", s))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return c.withColumn("new", F.row_number().over(w)).where(F.col("new") <= k).select("query_id", F.col("new").alias("rank"), "doc", "score", "rerank_score")


def search(candidates: DataFrame, top_k: int, source: str | None = None, limit: int = 12, score=None) -> DataFrame:  # noqa: ANN001
    """Search results: the source filter comes after the candidates are cut to ``limit``; then rerank.

    candidates: query_id, rank, doc, score, text, content, source. top_k is clamped to 1..20.
    Sources are equal without outer white space and letter case. ``score`` as in ``rerank``.
    """
    c = candidates.where(F.col("rank") <= limit)
    if source is not None and source.strip():
        c = c.where(F.lower(strip(F.col("source"))) == source.strip().lower())
    return rerank(c, clamp(top_k, 1, 20), score)


def shape_results(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Result rows: query_id, rank, content, source, page, chunk_index, vector_score, rerank_score."""
    d = docs.select("doc", squeeze(F.col("content")).alias("content"), "source", "page_number", "chunk_index")
    return ranked.join(d, "doc").select("query_id", "rank", "content", "source", F.col("page_number").alias("page"), "chunk_index", F.col("score").alias("vector_score"), "rerank_score")
