"""Readers of the driver's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Table ``name``; only ``columns`` are read from the files when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def once(df: DataFrame, key: str) -> DataFrame:
    """Records delivered several times (all columns equal) counted once; a null key is no record.

    ``first`` over a hash aggregate combines on the map side, so a record redelivered very
    often doesn't pile up in one task.
    """
    rest = [c for c in df.columns if c != key]
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in rest])
    return out.select(*df.columns)
