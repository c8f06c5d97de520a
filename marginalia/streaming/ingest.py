"""Incremental ingestion: new files of chunks are merged into the vector store as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.functions.text import text_to_embed
from marginalia.plugins import Embedder, HashedWords, embed_column
from marginalia.sources.store import VectorStore


def ingest_stream(spark: SparkSession, folder: str, schema: str, store: VectorStore, checkpoint: str, make: Callable[[], Embedder] = HashedWords, *, once: bool = True) -> StreamingQuery:
    """Parquet files of chunks that land in ``folder`` are embedded and merged by point id.

    A micro-batch that is repeated after a failure merges the same points again, so the store ends
    up the same. Chunks without content are left out.
    """

    def merge(batch: DataFrame, _: int) -> None:
        b = batch.where("content IS NOT NULL AND content <> ''")
        points = b.withColumn("vector", embed_column(text_to_embed(F.col("embedding_text"), F.col("content")), make))
        if not points.isEmpty():
            store.upsert(points)

    w = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()
