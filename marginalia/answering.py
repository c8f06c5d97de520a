"""From questions to cited answers: retrieval, reranking, evidence, prompt, model, rendering, bibliography."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import plugins
from marginalia.operators import citations, dense, ranking
from marginalia.operators.bibliography import stem
from marginalia.session import staged

CANDIDATES, TOP_K = 12, 5


@dataclass(frozen=True)
class Answers:
    """results: query_id, rank, content, source, page, chunk_index, vector_score, rerank_score; evidence: query_id, id,
    content, source, page_number, reference_numbers; prompts: query_id, prompt; answers: query_id, question,
    answer (null if the model failed), rendered; bibliography: query_id, pos, source, number, content."""

    results: DataFrame
    evidence: DataFrame
    prompts: DataFrame
    answers: DataFrame
    bibliography: DataFrame


def answer(questions: DataFrame, points: DataFrame, references: DataFrame, *, embedder: Callable[[], plugins.Embedder] = plugins.HashedWords, scorer: Callable[[], plugins.PairScorer] | None = None, client: Callable[[], plugins.Client] = plugins.StubClient, candidates: int = CANDIDATES, top_k: int = TOP_K) -> Answers:
    """All questions (query_id, text) at once over points (doc, content, source, page_number, chunk_index, vector).

    references: stem, number, content. A question that is blank, or has no results, no evidence or an empty
    answer, has no row in ``answers``.
    """
    q = staged(questions.where(F.col("query_id").isNotNull() & F.col("text").rlike(r"(?U)\S")).select("query_id", F.trim("text").alias("text")))
    asked = q.select("query_id", plugins.embed_column(F.col("text"), embedder).alias("vector"))
    pool = dense.dense_retrieve(points.select("doc", "vector"), asked, points.select("doc", "content"), candidates)
    score = (lambda a, b: plugins.score_column(a, b, scorer)) if scorer else None
    best = staged(ranking.rerank(pool.join(points.select("doc", "content"), "doc").join(q, "query_id"), top_k, score))
    results = ranking.shape_results(best, points)
    chunks = best.join(points.select("doc", "source", "page_number", "content"), "doc")
    sources = points.select("source").distinct()
    known = sources.withColumn("stem", stem(F.col("source"))).join(references, "stem").select("source", "number", F.col("content"))
    evidence = staged(citations.build_evidence(chunks.select("query_id", "rank", "source", "page_number", "content"), known))
    prompts = staged(citations.prompts(q, evidence))
    # A model's answers are asked for once, then stored.
    raw = staged(plugins.answers(prompts, client)).where("answer IS NULL OR answer <> ''")
    rendered = citations.render(raw, evidence).join(q.withColumnRenamed("text", "question"), "query_id").select("query_id", "question", "answer", "rendered")
    return Answers(results, evidence, prompts, rendered, citations.final_bibliography(rendered, known))
