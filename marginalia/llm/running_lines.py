"""Lines repeated across one source's documents, by distributed PrefixSpan.

A source's pages are sequences of line identifiers (the blocks at the page's edge in reading
order). Frequent sequences grow level by level: each level extends the occurrences of the
frequent ones of the level before (the projected database, one row per occurrence's earliest
end) by the frequent lines that follow on the same page, and counts distinct pages. Every step
is a join and an aggregate keyed by (source, page) or (source, sequence), so a source with a
third of all rows is spread over all tasks; only frequent lines, a few per page, take part
from the second level on.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import staged


def line_form(c: Column) -> Column:
    """Lines agree after lower-casing, each run of digits 0-9 taken as one sign."""
    return F.regexp_replace(F.lower(c), "[0-9]+", "\u0001")


def line_id(c: Column) -> Column:
    return F.unhex(F.md5(line_form(c)))


def at_edge(y0: Column, page_height: Column, margin: float = 0.12) -> Column:
    """Whether a block starts in the top or bottom margin; null coordinates give null."""
    return (y0 < margin * page_height) | (y0 >= (1 - margin) * page_height)


def edge_lines(blocks: DataFrame) -> DataFrame:
    """blocks: block_id, source, page_number, block_index, content, y0, page_height, each record
    once. Result: block_id, source, page_number, pos, line, edge (null where y0 is null)."""
    return blocks.where(F.col("source").isNotNull() & F.col("content").isNotNull()).select(
        "block_id", "source", "page_number", F.col("block_index").alias("pos"), line_id(F.col("content")).alias("line"), at_edge(F.col("y0"), F.col("page_height")).alias("edge")
    )


def support_table(blocks: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(source, least): the number of distinct pages a sequence must stand on."""
    pages = blocks.where(F.col("source").isNotNull()).select("source", "page_number").distinct().groupBy("source").agg(F.count("page_number").alias("pages"))
    return pages.select("source", F.greatest(F.lit(min_pages), F.ceil(F.lit(min_share) * F.col("pages") - F.lit(1e-9))).cast("long").alias("least"))


def prefix_span(lines: DataFrame, support: DataFrame, max_length: int | None = None) -> DataFrame:
    """Frequent sequences per source: source, sequence (array of line ids), pages.

    ``lines``: source, page_number, pos, line. A sequence is supported by a page where its lines
    stand in this order, with or without others between. Sequences grow until none is frequent, at
    the latest at the number of frequent lines a page holds; a ``max_length`` stops them earlier.
    """
    db = lines.where(F.col("page_number").isNotNull() & F.col("pos").isNotNull()).select("source", "page_number", "pos", "line")
    first = db.groupBy("source", "page_number", "line").agg(F.min("pos").alias("end"))
    counted = first.groupBy("source", "line").agg(F.count(F.lit(1)).alias("pages"))
    one = staged(counted.join(support, "source").where("pages >= least").select("source", F.array("line").alias("sequence"), "pages", "least"))
    found = one.select("source", "sequence", "pages")
    if max_length == 1 or one.isEmpty():
        return found
    items = one.select("source", F.col("sequence")[0].alias("line"))
    db = staged(db.join(items, ["source", "line"], "left_semi"))
    # Occurrences of the frequent sequences: the earliest end on each page.
    ends = first.join(items, ["source", "line"], "left_semi").select("source", "page_number", F.array("line").alias("sequence"), "end")
    for _ in count() if max_length is None else range(max_length - 1):
        grown = (
            ends.join(db, ["source", "page_number"])
            .where("pos > end")
            .groupBy("source", "page_number", F.concat("sequence", F.array("line")).alias("sequence"))
            .agg(F.min("pos").alias("end"))
        )
        grown = staged(grown)
        frequent = staged(grown.groupBy("source", "sequence").agg(F.count(F.lit(1)).alias("pages")).join(support, "source").where("pages >= least").select("source", "sequence", "pages"))
        if frequent.isEmpty():
            break
        found = found.unionByName(frequent)
        ends = grown.join(frequent, ["source", "sequence"], "left_semi")
    return found


def repeated_line_blocks(blocks: DataFrame, *, min_pages: int = 3, min_share: float = 0.3, max_length: int = 3) -> DataFrame:
    """Block ids of the occurrences of frequent sequences (single lines included).

    An occurrence counts at the edge, or where y0 is unknown (null). Null sources, contents and
    block ids give no case; an empty content is a line like any other. Each record once. The result
    doesn't depend on ``max_length``: every line of a frequent sequence is one of length one.
    Extra columns are ignored; empty tables give an empty result.
    """
    lines = staged(edge_lines(blocks))
    support = support_table(blocks, min_pages, min_share)
    frequent = prefix_span(lines.where("edge"), support, max_length)
    members = frequent.select("source", F.explode("sequence").alias("line")).distinct()
    return lines.where(F.coalesce(F.col("edge"), F.lit(True))).join(members, ["source", "line"], "left_semi").select("block_id")


def without_repeated_lines(blocks: DataFrame, **how: float) -> DataFrame:
    """``blocks`` without the occurrences; blocks without a source or id stay."""
    gone = repeated_line_blocks(blocks, **how).distinct()
    return blocks.join(gone, "block_id", "left_anti")
