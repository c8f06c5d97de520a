"""Reports on chunks and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import tokens, words
from marginalia.operators.running import running


def with_size(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``size`` in tokens, counted whatever token_count says."""
    return chunks.withColumn("size", F.size(tokens(F.coalesce("content", F.lit("")))))


def quality_report(chunks: DataFrame, small: int = 100, large: int = 320) -> DataFrame:
    """One row: chunks, distinct sections, without section, across pages, small, large, without source,
    surplus copies (equal words in the same order)."""
    c = with_size(chunks).withColumn("copy", F.xxhash64(F.array_join(words(F.lower(F.coalesce("content", F.lit("")))), " ")))
    main = c.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("section_title").alias("sections"), F.count_if(F.col("section_title").isNull()).alias("sectionless"), F.count_if(F.col("page_end") > F.col("page_number")).alias("cross_page"),
        F.count_if(F.col("size") < small).alias("small"), F.count_if(F.col("size") > large).alias("large"), F.count_if(F.coalesce("source", F.lit("")) == "").alias("sourceless"), (F.count(F.lit(1)) - F.count_distinct("copy")).alias("surplus_copies"),
    )
    return main


def token_distribution(chunks: DataFrame) -> DataFrame:
    s = with_size(chunks)
    return s.agg(F.min("size").alias("min"), F.median("size").alias("median"), F.round(F.avg("size"), 6).alias("mean"), F.max("size").alias("max"))


def block_types(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("content_type").agg(F.count(F.lit(1)).alias("n")).orderBy("content_type")


def smallest_chunks(chunks: DataFrame, n: int = 5) -> DataFrame:
    return with_size(chunks).select("chunk_id", "size").orderBy("size", "chunk_id").limit(n)


def oversized_chunks(chunks: DataFrame, limit: int = 320, n: int = 5) -> DataFrame:
    return with_size(chunks).where(F.col("size") > limit).select("chunk_id", "size").orderBy("chunk_id").limit(n)


def section_names(chunks: DataFrame) -> DataFrame:
    return chunks.where("section_title IS NOT NULL").select("section_title").distinct().orderBy("section_title")


def sample_positions(chunks: DataFrame) -> DataFrame:
    """Chunks at five positions of each source: first, quarter, half, three quarters, last."""
    one = chunks.where("chunk_index IS NOT NULL").select("source", "chunk_index").distinct()
    n = one.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    placed = running(one, {"place": ("sum", F.lit(1))}, ("chunk_index",), inclusive=False)
    picks = n.select("source", F.explode(F.array_distinct(F.array(*[F.least(F.floor(F.col("n") * q), F.col("n") - 1).cast("bigint") for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))).alias("pick"))
    same = F.col("p.source").eqNullSafe(F.col("o.source")) & (F.col("p.pick") == F.col("o.place"))
    return picks.alias("p").join(placed.alias("o"), same).select("o.source", "o.chunk_index")


def ingest_counters(pages: DataFrame, blocks: DataFrame, refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """pages, blocks, refs and chunks of each source; a null source is the grand total."""
    parts = None
    for name, df in (("pages", pages), ("blocks", blocks), ("refs", refs), ("chunks", chunks)):
        one = df.where("source IS NOT NULL").groupBy(F.regexp_replace("source", r"(?i)\.pdf$", "").alias("source")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    assert parts is not None
    sums = [F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in ("pages", "blocks", "refs", "chunks")]
    return parts.rollup("source").agg(*sums)
