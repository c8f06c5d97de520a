"""Retrieval metrics in their three variants, all queries and cut-offs from one ranked table.

ranked: query_id, rank, source, page_number; gold: query_id, source, page_number (relevant pages).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("hit", "precision", "recall", "reciprocal_rank")


def _metrics(judged: DataFrame, gold: DataFrame, page: list[str], denominator) -> DataFrame:  # noqa: ANN001
    """judged: query_id, rank, relevant and the page's columns."""
    p = F.struct(*page)
    per = judged.groupBy("query_id").agg(
        F.count_distinct(F.when(denominator, p)).alias("shown"),
        F.count_distinct(F.when(F.col("relevant"), p)).alias("good"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
    )
    want = gold.groupBy("query_id").agg(F.count_distinct(p).alias("want"))
    m = want.join(per, "query_id", "left").fillna({"shown": 0, "good": 0})
    return m.select(
        "query_id",
        F.when(F.col("good") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(F.col("good") / F.nullif(F.col("shown"), F.lit(0)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.col("good") / F.nullif(F.col("want"), F.lit(0)), F.lit(0.0)).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def _judged(ranked: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    g = gold.select("query_id", *keys).distinct().withColumn("relevant", F.lit(True))
    return ranked.join(g, ["query_id", *keys], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def by_source_page(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(source, page) pairs; precision over all distinct pairs shown. For gold of several documents."""
    keys = ["source", "page_number"]
    return _metrics(_judged(ranked, gold, keys), gold, keys, F.lit(True))


def by_single_source(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold of one source a query; precision over the distinct pages shown of that source only."""
    one = gold.groupBy("query_id").agg(F.first("source").alias("gold_source"))
    j = _judged(ranked, gold, ["source", "page_number"]).join(one, "query_id", "left")
    return _metrics(j, gold, ["page_number"], F.col("source") == F.col("gold_source"))


def by_page_only(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Page numbers only, whatever the source."""
    return _metrics(_judged(ranked, gold, ["page_number"]), gold, ["page_number"], F.lit(True))


def macro(metrics: DataFrame, *groups: str) -> DataFrame:
    """Means over queries; 0 for none."""
    return metrics.groupBy(*groups).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in METRICS])


def k_sweep(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Macro means at each cut-off: the ranks are computed once, each cut-off is a filter."""
    out = None
    for k in ks:
        one = macro(by_source_page(ranked.where(F.col("rank") <= k), gold)).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    assert out is not None
    return out
