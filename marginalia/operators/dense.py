"""Nearest neighbours by cosine, and greedy suppression of near-copies among results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import words

DUPLICATE = 0.80
#: Documents whose best one is taken together to find a bound.
GROUP = 64


def _best(query: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows (query, score, doc) of each query, ties to the lower doc; ordered by query."""
    order = np.lexsort((doc, -score, query))
    query, score, doc = query[order], score[order], doc[order]
    new = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
    place = np.arange(len(query))
    first = place - np.maximum.accumulate(np.where(new, place, 0)) < k
    return query[first], score[first], doc[first]


def vector_topk(index: DataFrame, queries: DataFrame, k: int, *, block: int = 2048, per_scan: int = 32_768) -> DataFrame:
    """query_id, rank, doc, score: the k most similar vectors of each query, exactly.

    index: doc, vector; queries: query_id, vector (one dimension throughout). A stated query set is
    compared with all rows: each task multiplies its batches with blocks of at most ``block`` queries and
    keeps k rows a query, so little more than k rows a query and task is exchanged. One scan of the
    index serves up to ``per_scan`` queries. Null vectors have no neighbours and are none; null vectors of
    zero length are similar to nothing (0). Ties go to the lower doc.
    """
    spark = index.sparkSession
    some = queries.where("vector IS NOT NULL AND query_id IS NOT NULL").select("query_id", "vector")
    scans = max(1, -(-some.count() // per_scan))
    found = None
    for n in range(scans):
        part = some if scans == 1 else some.where(F.pmod(F.xxhash64("query_id"), F.lit(scans)) == n)
        rows = part.toPandas()  # the queries of one scan: bounded, whatever the corpus
        if rows.empty:
            continue
        q = np.array(rows["vector"].tolist(), np.float64)
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), q, np.linalg.norm(q, axis=1)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ids, q, length = shared.value
            best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            least: dict[int, np.ndarray] = {}
            for x in batches:
                v = np.array(x["vector"].tolist(), np.float64)
                if not len(v):
                    continue
                norm, docs = np.linalg.norm(v, axis=1), x["doc"].to_numpy()
                for at in range(0, len(q), block):
                    with np.errstate(all="ignore"):
                        s = q[at : at + block] @ v.T
                        s /= length[at : at + block, None]
                        s /= norm[None]
                    if not (norm.all() and length[at : at + block].all()):
                        np.nan_to_num(s, copy=False)
                    # Only what reaches the k-th best so far, before rounding, can be among the k best.
                    if at not in least:
                        least[at] = np.full(len(s), -np.inf)
                    if s.shape[1] > GROUP * k:
                        groups = np.maximum.reduceat(s, np.arange(0, s.shape[1], GROUP), axis=1)
                        least[at] = np.maximum(least[at], np.partition(groups, -k, axis=1)[:, -k])
                    r, c = np.nonzero(s >= least[at][:, None] - 2e-6)
                    own = r, np.round(s[r, c], 6), docs[c]
                    if at in best:
                        own = tuple(np.concatenate(y) for y in zip(best[at], own, strict=True))
                    best[at] = _best(*own, k)
                    size = np.bincount(best[at][0], minlength=len(s))
                    full = size >= k
                    least[at][full] = np.maximum(least[at][full], best[at][1][np.cumsum(size) - 1][full] - 1e-6)
            for at, (r, s, doc) in best.items():
                yield pd.DataFrame({"query_id": ids[at : at + block][r], "doc": doc, "score": s})

        one = index.where("vector IS NOT NULL AND doc IS NOT NULL").select("doc", "vector").mapInPandas(run, "query_id bigint, doc bigint, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, doc bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc", "score")


def greedy_dedup(ranked: DataFrame, k: int) -> DataFrame:
    """Of each query's candidates, best first, those that are no near-copy of one kept before; k at most.

    ranked: query_id, rank, doc, content, score. Contents are compared by the share of common words
    (``DUPLICATE`` or more is a copy; without words never). The candidates of a query are a
    ranked list of bounded length, folded in one row.
    """
    c = ranked.where(F.col("content").isNotNull() & (F.col("content") != "")).select(
        "query_id", F.struct("rank", "doc", "score", F.array_distinct(words(F.lower("content"))).alias("set")).alias("c")
    )
    rows = c.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("all"))

    def step(kept, x):  # noqa: ANN001, ANN202
        def copy(y):  # noqa: ANN001, ANN202
            return (F.size(x["set"]) > 0) & (F.size(y["set"]) > 0) & (F.size(F.array_intersect(x["set"], y["set"])) >= DUPLICATE * F.size(F.array_union(x["set"], y["set"])))

        return F.when((F.size(kept) >= k) | F.exists(kept, copy), kept).otherwise(F.concat(kept, F.array(x)))

    rows = rows.withColumn("kept", F.aggregate("all", F.slice("all", 1, 0), step))
    return rows.select("query_id", F.posexplode("kept").alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), "x.doc", "x.score")


def dense_retrieve(index: DataFrame, queries: DataFrame, contents: DataFrame, k: int, candidates: int | None = None) -> DataFrame:
    """Over-fetch (``candidates``, else three times k), then greedy suppression down to k."""
    found = vector_topk(index, queries, candidates or 3 * k)
    return greedy_dedup(found.join(contents.select("doc", "content"), "doc"), k)
