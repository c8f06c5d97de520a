"""The queries of this package with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, mixture, neardup, personal, running_lines, scan_noise, sentences, split, visual
from marginalia.session import staged
from marginalia.sources.tables import once, read


def _p2(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    b = visual.visual_keys(read(spark, sf, "blocks", ["block_id", "content"]), "block_id", "content")
    r = visual.visual_keys(read(spark, sf, "refs", ["ref_id", "content"]), "ref_id", "content")
    # The one form is computed once; hashes are stored.
    return {"blocks": staged(b), "refs": staged(r)}


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return visual.visual_twins(_p2(spark, sf))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every record whose look several texts have, with its class."""
    return visual.visual_classes(_p2(spark, sf)).withColumnRenamed("id", "row_id")


def p2_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """The one form of every text of both tables."""
    b = once(read(spark, sf, "blocks", ["block_id", "content"]), "block_id")
    r = once(read(spark, sf, "refs", ["ref_id", "content"]), "ref_id")
    return visual.canonical_text(
        b.select(F.lit("blocks").alias("tbl"), F.col("block_id").alias("row_id"), "content").unionByName(r.select(F.lit("refs").alias("tbl"), F.col("ref_id").alias("row_id"), "content")), "content"
    ).select("tbl", "row_id", "canonical")


def _p3(spark: SparkSession, sf: str) -> DataFrame:
    c = sentences.sentence_ends(once(read(spark, sf, "chunks", ["chunk_id", "content"]), "chunk_id"), "chunk_id", "content")
    e = sentences.sentence_ends(once(read(spark, sf, "evidence", ["ev_id", "content"]), "ev_id"), "ev_id", "content")
    return c.withColumn("tbl", F.lit("chunks")).unionByName(e.withColumn("tbl", F.lit("evidence"))).withColumnRenamed("id", "row_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p3(spark, sf).select("tbl", "row_id", "sent_end")


_P4_COLUMNS = ["block_id", "source", "page_number", "block_index", "content", "y0", "page_height"]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return running_lines.repeated_line_blocks(once(read(spark, sf, "blocks", _P4_COLUMNS), "block_id"))


def p4_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """The frequent sequences: per source, the number of lines, of pages, and the lines' ids."""
    b = once(read(spark, sf, "blocks", _P4_COLUMNS), "block_id")
    f = running_lines.prefix_span(running_lines.edge_lines(b).where("edge"), running_lines.support_table(b, 3, 0.3))
    return f.select("source", F.size("sequence").alias("n_lines"), "pages", F.transform("sequence", lambda x: F.lower(F.hex(x))).alias("lines"))


def p4_clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Number of blocks and characters left on each page once repeated lines are out."""
    b = once(read(spark, sf, "blocks", _P4_COLUMNS), "block_id")
    return running_lines.without_repeated_lines(b).groupBy("source", "page_number").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("content")).alias("n_chars"))


def _p5(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "chunks", ["chunk_id", "content"]).select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("id"), "content")
    e = read(spark, sf, "evidence", ["ev_id", "content"]).select(F.lit("evidence").alias("tbl"), F.col("ev_id").alias("id"), "content")
    return c.unionByName(e)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicate_pairs(_p5(spark, sf))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicate_groups(_p5(spark, sf)).withColumnRenamed("id", "row_id")


def _p6(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, sf, "doc_pages", ["page_id", "source", "page_number", "content"]).withColumnRenamed("page_id", "row_id")
    b = read(spark, sf, "blocks", ["block_id", "source", "page_number", "block_index", "content"]).withColumnRenamed("block_id", "row_id").withColumnRenamed("block_index", "pos")
    # Redelivered rows give the same lines again; those are made one where only numbers are exchanged.
    return p, b


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return scan_noise.noisy_lines(*_p6(spark, sf))[0]


def p6_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous paragraphs of both tables."""
    p, _ = _p6(spark, sf)
    b = read(spark, sf, "blocks", _P4_COLUMNS).withColumnRenamed("block_id", "row_id").withColumnRenamed("block_index", "pos")
    return scan_noise.all_paragraphs(staged(once(p, "row_id")), staged(once(b, "row_id")))


#: Limit and overlap in units of each table.
P7_LIMITS = {"doc_pages": (600, 60), "chunks": (320, 40)}


def _p7(spark: SparkSession, sf: str, table: str, key: str, large: bool) -> DataFrame:
    limit, overlap = P7_LIMITS[table]
    df = read(spark, sf, table, [key, "content"]).where(F.col("content").isNotNull())
    # Redelivered rows are met after splitting, where only numbers are exchanged.
    df = split.oversized(df, "content", limit) if large else df
    return split.split_items(df, key, "content", limit, overlap).select(F.lit(table).alias("tbl"), F.col("id").alias("row_id"), "piece", "start_pos", "core_pos", "end_pos", "units", "content")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    cut = _p7(spark, sf, "doc_pages", "page_id", True).unionByName(_p7(spark, sf, "chunks", "chunk_id", True))
    return cut.where("piece = 1").select("tbl", "row_id").distinct()


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All pieces of both tables, those of items within the limit too."""
    cut = _p7(spark, sf, "doc_pages", "page_id", False).unionByName(_p7(spark, sf, "chunks", "chunk_id", False))
    return cut.dropDuplicates(["tbl", "row_id", "piece"])


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_table(read(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text")


def _sized(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets = read(spark, sf, "mix_targets")
    docs = read(spark, sf, "documents", ["doc_id", "source", "text"]).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    sized = staged(bpe.token_counts(docs, "text").select("doc_id", "source", "tokens").groupBy("doc_id").agg(F.first("source").alias("source"), F.first("tokens").alias("tokens")))
    return sized, targets


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mix(*_sized(spark, sf))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    sized, targets = _sized(spark, sf)
    return mixture.mix_shares(mixture.mix(sized, targets), sized, targets)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal.find_personal(read(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_masked(spark: SparkSession, sf: str) -> DataFrame:
    return personal.masked_text(read(spark, sf, "documents", ["doc_id", "text"]), "text").select("doc_id", "masked")


QUERIES = {
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p2_canonical": p2_canonical,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_sequences": p4_sequences,
    "p4_clean_pages": p4_clean_pages,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_paragraphs": p6_paragraphs,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_masked": p10_masked,
}

_P4_SQL = r"""
WITH b AS (SELECT DISTINCT block_id, source, page_number, block_index, content, y0, page_height FROM blocks WHERE block_id IS NOT NULL),
l AS (SELECT *, regexp_replace(lower(content), '[0-9]+', chr(1), 'g') AS line, (y0 < 0.12 * page_height OR y0 >= (1 - 0.12) * page_height) AS edge FROM b),
n AS (SELECT source, greatest(3, ceil(0.3 * count(DISTINCT page_number) - 1e-9)) AS least FROM b GROUP BY source),
f AS (SELECT l.source, line FROM l JOIN n ON n.source = l.source WHERE edge AND content IS NOT NULL GROUP BY l.source, line, least HAVING count(DISTINCT page_number) >= least),
c AS (SELECT block_id FROM l JOIN f USING (source, line) WHERE coalesce(edge, true))
"""
_P7_UNITS = "length(regexp_replace(regexp_replace({c}, '[\\x{{0e00}}-\\x{{0e7f}}\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]', ' \u0001 ', 'g'), '[^\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '\u0001', 'g')) - length(replace(regexp_replace(regexp_replace({c}, '[\\x{{0e00}}-\\x{{0e7f}}\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]', ' \u0001 ', 'g'), '[^\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '\u0001', 'g'), '\u0001', ''))"
ORACLES: dict[str, str] = {
    "p7_found": "SELECT DISTINCT 'doc_pages' AS tbl, page_id AS row_id FROM doc_pages WHERE page_id IS NOT NULL AND " + _P7_UNITS.format(c="content") + " > 600 UNION ALL SELECT DISTINCT 'chunks', chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND " + _P7_UNITS.format(c="content") + " > 320",
    "p4_found": _P4_SQL + "SELECT block_id FROM c",
    "p4_clean_pages": _P4_SQL + "SELECT source, page_number, count(*) AS n_blocks, sum(length(content)) AS n_chars FROM b WHERE block_id NOT IN (SELECT block_id FROM c) GROUP BY ALL",
}
