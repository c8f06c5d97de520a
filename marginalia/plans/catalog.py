"""All queries of the core with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans import citing, ingesting, integrity, retrieval, serving, texts

_MODULES = (integrity, texts, retrieval, ingesting, citing, serving)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hybrid_topk(spark, sf)
