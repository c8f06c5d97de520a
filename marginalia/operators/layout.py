"""Blocks of pages: margins, classes, sections. Order columns: page_number, pos.

Running state along a source (sections) is taken in two steps, over page ranges and within them; no
window sorts all blocks of a source.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import clean_noise, clean_text, is_page_number, margin_signature, normalize_heading, strip, word_count
from marginalia.operators.running import running
from marginalia.session import staged

MARGIN = 0.12
DEFAULT_FONT = 10.0

# Patterns of the block classes.
TABLE = r"(?i)^\s*Table\s+\d+"
FIGURE = r"(?i)^\s*(?:Figure|Fig\.)\s*\d+"
BACK_MATTER = r"(?i)^\s*(?:Acknowledg(?:e)?ments|Data Availability|Conflict of Interest|Disclosure of Conflict of Interest|Compliance with Ethical Standards|Author Contributions)\s*$"
FRONT_MATTER = r"(?i)\b(?:Correspondence|Received|Revised|Accepted|Funding|Grant/Award|Department of|University|Institute|Laboratory|Email)\b"
NUMBERED_HEADING = r"^\s*\d+(?:\.\d+){0,4}\s*(?:\|\s*)?[A-Z]"
KNOWN_HEADING = r"(?i)^\s*(?:Abstract|Introduction|Background|Methodology|Methods?|Results?|Discussion|Conclusion|Conclusions|Future Work|Future Directions|Challenges|Outlook|Outlooks)\s*$"
INLINE_HEADING = r"^(\d+(?:\.\d+){1,4}\s*(?:\|\s*)?[A-Z][^.!?]{1,120}[.!?])\s+(.+)$"
REFERENCES_BLOCK = r"(?i)^\s*References\s*$"


def in_margin(y0: Column, y1: Column, height: Column) -> Column:
    """Ends in the top margin or starts in the bottom one; false where a coordinate is null."""
    return F.coalesce((y1 <= MARGIN * height) | (y0 >= (1 - MARGIN) * height), F.lit(False))


def is_bold(font: Column, flags: Column) -> Column:
    return F.coalesce(F.lower(font).rlike("bold|demi"), F.lit(False)) | (F.coalesce(flags, F.lit(0)).bitwiseAND(16) != 0)


def margin_signatures(blocks: DataFrame, min_pages: int = 3, share: float = 0.30, physical: DataFrame | None = None) -> DataFrame:
    """source, signature, pages: signatures in the margins of at least max(min_pages, share of pages).

    The share is of the pages in ``physical`` (source, all_pages: blank ones too) where given, else of those with blocks."""
    counts = physical.select("source", "all_pages") if physical is not None else blocks.select("source", "page_number").distinct().groupBy("source").agg(F.count("page_number").alias("all_pages"))
    m = blocks.where(in_margin(F.col("y0"), F.col("y1"), F.col("page_height"))).select("source", "page_number", margin_signature(F.col("content")).alias("signature"))
    m = m.where(F.col("signature") != "").distinct().groupBy("source", "signature").agg(F.count("page_number").alias("pages"))
    return m.join(counts, "source").where(F.col("pages") >= F.greatest(F.lit(min_pages), F.ceil(share * F.col("all_pages")))).select("source", "signature", "pages")


def without_margins(blocks: DataFrame, physical: DataFrame | None = None, *, page_numbers: bool = True) -> DataFrame:
    """Blocks that are neither a page number (with ``page_numbers``) nor a repeated signature in the margin."""
    b = blocks.withColumn("signature", margin_signature(F.col("content"))).withColumn("margin", in_margin(F.col("y0"), F.col("y1"), F.col("page_height")))
    b = b.where(~is_page_number(F.col("content"))) if page_numbers else b
    gone = margin_signatures(blocks, physical=physical).select("source", "signature", F.lit(True).alias("margin"))
    return b.join(gone, ["source", "signature", "margin"], "left_anti").drop("signature", "margin")


def reassemble(blocks: DataFrame, *keys: str, sep: str = "\n\n") -> DataFrame:
    """Contents put together in order; a page is one row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    return blocks.where(F.col("content").isNotNull()).groupBy(*keys).agg(F.array_join(parts, sep).alias("content"))


def layout_pages(blocks: DataFrame, physical: DataFrame | None = None) -> DataFrame:
    """Pages (source, page_number, content) of cleaned blocks in reading order, without margins and page numbers."""
    b = staged(blocks.select("source", "page_number", "pos", clean_text(F.col("content")).alias("content"), "y0", "y1", "page_height").where("content <> ''"))
    return reassemble(without_margins(b, physical), "source", "page_number")


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with banners, surplus blanks and page numbers taken out; emptied ones are dropped."""
    return blocks.withColumn("content", clean_noise(F.col("content"))).where("content <> ''")


def renumbered(blocks: DataFrame) -> DataFrame:
    """Pieces of ``split_inline_headings`` as blocks: ``pos`` orders block and piece."""
    return blocks.withColumn("pos", F.shiftleft(F.col("pos").cast("bigint"), 32) + F.col("piece")).drop("piece")


def body_font_size(blocks: DataFrame) -> DataFrame:
    """source, body: median font size of blocks with five words or more; 10.0 where there is none."""
    size = F.when((word_count(F.col("content")) >= 5) & F.col("font_size").isNotNull(), F.col("font_size"))
    return blocks.groupBy("source").agg(F.coalesce(F.median(size), F.lit(DEFAULT_FONT)).alias("body"))


def classify(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``kind``; the first rule that holds decides."""
    b = blocks.join(body_font_size(blocks), "source")
    t, n, size = strip(F.coalesce("content", F.lit(""))), word_count(F.col("content")), F.col("font_size")
    first = F.col("page_number") == 1
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = (
        F.when(t.rlike(TABLE), "table")
        .when(t.rlike(FIGURE), "figure_caption")
        .when(t.rlike(BACK_MATTER), "back_matter")
        .when(yes(first & t.rlike(FRONT_MATTER)), "metadata")
        .when(yes(first & (size >= F.col("body") + 2.0) & (n <= 40)), "title")
        .when(t.rlike(NUMBERED_HEADING) | t.rlike(KNOWN_HEADING), "heading")
        .when(yes((n <= 20) & (size >= F.col("body") + 1.0)), "heading")
        .when(yes((n <= 20) & F.col("is_bold") & (size >= F.col("body"))), "heading")
        .otherwise("prose")
    )
    return b.withColumn("kind", kind).drop("body")


def split_inline_headings(blocks: DataFrame) -> DataFrame:
    """Every line is a block of its own; a numbered heading with text behind it becomes two.

    ``piece`` orders the pieces of a block."""
    lines = F.filter(F.transform(F.split("content", r"\r\n|\n|\r"), strip), lambda x: x != "")
    pieces = F.flatten(
        F.transform(lines, lambda x: F.when(x.rlike(INLINE_HEADING), F.array(strip(F.regexp_extract(x, INLINE_HEADING, 1)), strip(F.regexp_extract(x, INLINE_HEADING, 2)))).otherwise(F.array(x)))
    )
    return blocks.select(*[c for c in blocks.columns if c != "content"], F.posexplode(pieces).alias("piece", "content"))


def until_references(blocks: DataFrame) -> DataFrame:
    """Blocks before the source's first block that is exactly "References".

    One aggregate finds that block; nothing is sorted."""
    cut = blocks.where(F.col("content").rlike(REFERENCES_BLOCK)).groupBy("source").agg(F.min(F.struct("page_number", "pos")).alias("cut"))
    return blocks.join(cut, "source", "left").where(F.col("cut").isNull() | (F.struct("page_number", "pos") < F.col("cut"))).drop("cut")


def section_titles(blocks: DataFrame) -> DataFrame:
    """``blocks`` (with kind) with ``section``: the title of the last heading, forward-filled."""
    return running(blocks, {"section": ("last", F.when(F.col("kind") == "heading", normalize_heading(F.col("content"))))})


def section_paths(blocks: DataFrame) -> DataFrame:
    """``blocks`` (with kind) with ``path``: the titles of the sections around each; as in ``sections``."""
    return sections(blocks).drop("section", "head")


def sections(blocks: DataFrame, *, normalized: bool = True) -> DataFrame:
    """``blocks`` (with kind) with section (title of the last heading), path (titles of the sections around) and
    head (how many headings the source had so far).

    A heading with a number of n parts keeps the first n - 1 entries of the path before it; one without
    a number starts anew. The depth after heading k is therefore the least of L(j) + k - j over the
    headings j up to k (with L = 1 for unnumbered ones), which is a running minimum, and each
    entry is the last heading of its depth: running values over the headings, no fold. A heading
    without a page sets no section. Titles are ``normalized`` headings, or headings as they are.
    """
    at = ["source", "page_number", "pos"]
    h = blocks.where("kind = 'heading'").select(*at, (normalize_heading(F.col("content")) if normalized else F.col("content")).alias("title"))
    b = blocks.join(heading_paths(h).select(*at, "title", F.col("path").alias("_path"), F.col("k").alias("_head")), at, "left")
    b = running(b, {"section": ("last", F.col("title")), "path": ("last", F.col("_path")), "head": ("last", F.col("_head"))}).drop("title", "_path", "_head")
    return b.withColumns({"path": F.coalesce("path", F.array().cast("array<string>")), "head": F.coalesce("head", F.lit(0))})


def heading_paths(heads: DataFrame) -> DataFrame:
    """Headings (source, page_number, pos, title) with ``path``, to any depth: as many windows as the deepest one has parts."""
    number = F.regexp_extract(F.col("title"), r"^(\d+(?:\.\d+)*)", 1)
    h = heads.withColumn("level", F.when(number == "", 1).otherwise(F.size(F.split(number, r"\."))))
    h = running(h, {"k": ("sum", F.lit(1))})
    h = running(h, {"least": ("min", F.col("level") - F.col("k"))})
    h = staged(h.withColumn("depth", F.least(F.col("k"), F.col("k") + F.col("least")).cast("int")))
    deepest = h.agg(F.max("depth")).first()[0] or 1
    h = running(h, {f"d{d}": ("last", F.when(F.col("depth") == d, F.col("title"))) for d in range(1, deepest + 1)})
    entries = [F.when(F.col("depth") >= d, F.col(f"d{d}")) for d in range(1, deepest + 1)]
    return h.select(*heads.columns, "k", F.array_compact(F.array(*entries)).alias("path"))


def spans_to_blocks(spans: DataFrame) -> DataFrame:
    """Spans (source, page_number, block, span, text, font, size, flags, x0, y0, x1, y1) to typed blocks:
    the largest size, bold if half of the characters are."""
    bold = is_bold(F.col("font"), F.col("flags"))
    n = F.length("text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"])
    g = spans.groupBy("source", "page_number", F.col("block").alias("pos"))
    return g.agg(
        F.array_join(parts, "").alias("content"),
        F.max("size").alias("font_size"),
        F.coalesce(F.sum(F.when(bold, n).otherwise(0)) / F.nullif(F.sum(n), F.lit(0)) >= 0.5, F.lit(False)).alias("is_bold"),
        *[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))],
    )
