"""The ingestion pipelines: from pages and blocks to references and chunks, each stage a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.ids import parent_id
from marginalia.functions.text import clean_lines, clean_text, embedding_text
from marginalia.operators import bibliography, chunking, layout
from marginalia.session import staged


@dataclass(frozen=True)
class IngestionResult:
    """pages and main_pages: source, page_number, content; references: source, number, content; chunks: source,
    page_number, page_end, chunk_index, content, section_title, section_path, token_count, content_type,
    parent_id, embedding_text; blocks only of v2-block."""

    pipeline: str
    pages: DataFrame
    main_pages: DataFrame
    references: DataFrame
    chunks: DataFrame
    blocks: DataFrame | None = None


class Pipeline(Protocol):
    name: str
    description: str

    def ingest(self, pages: DataFrame | None, blocks: DataFrame | None = None) -> IngestionResult:
        """pages: source, page_number, content as extracted; blocks: source, page_number, pos, content, y0, y1,
        page_height, font_size, is_bold. Null sources and page numbers give nothing."""
        ...


def loaded(pages: DataFrame) -> DataFrame:
    """Pages in the clean form; blank ones are left out."""
    p = pages.where("source IS NOT NULL AND page_number IS NOT NULL").select("source", "page_number", clean_text(F.col("content")).alias("content"))
    return p.where("content <> ''")


def _chunks(chunks: DataFrame, *, embedded: bool, parents: bool) -> DataFrame:
    none = F.lit(None).cast("string")
    return chunks.withColumns(
        {
            "content_type": F.lit("paragraph"),
            "parent_id": parent_id(F.col("source"), F.col("section_path")) if parents else none,
            "embedding_text": embedding_text(F.col("content"), F.col("section_path")) if embedded else none,
        }
    )


class Words:
    """v1: pages as packed words."""

    name, description = "v1", "pages as packed words"

    def __init__(self, size: int = chunking.V1_SIZE, overlap: int = chunking.V1_OVERLAP) -> None:
        chunking.check_words(size, overlap)
        self.size, self.overlap = size, overlap

    def ingest(self, pages: DataFrame | None, blocks: DataFrame | None = None) -> IngestionResult:
        if pages is None:
            raise ValueError("v1 needs pages")
        p = staged(loaded(pages))
        main = bibliography.main_pages(p)
        return IngestionResult(self.name, p, main, bibliography.references(p), _chunks(chunking.chunk_v1(main, self.size, self.overlap), embedded=False, parents=False))


class Paragraphs:
    """v2-basic: paragraphs under a token budget, with sections. The content comes from the layout where blocks
    are given, the bibliography always from the plain pages where these are given."""

    name, description = "v2-basic", "paragraphs under a token budget, with sections"

    def __init__(self, packing: chunking.Packing = chunking.V2, make=chunking.WordTokens) -> None:  # noqa: ANN001
        self.packing, self.make = packing, make

    def ingest(self, pages: DataFrame | None, blocks: DataFrame | None = None) -> IngestionResult:
        if pages is None and blocks is None:
            raise ValueError("v2-basic needs pages or blocks")
        plain = staged(loaded(pages)) if pages is not None else None
        p = staged(layout.layout_pages(blocks)) if blocks is not None else plain
        main = bibliography.main_pages(p)
        chunks = chunking.chunk_v2_basic(main, self.packing, self.make)
        return IngestionResult(self.name, p, main, bibliography.references(plain if plain is not None else p), _chunks(chunks, embedded=True, parents=False))


class Blocks:
    """v2-block: typed blocks under a token budget, with section paths."""

    name, description = "v2-block", "typed blocks under a token budget, with section paths"

    def __init__(self, packing: chunking.Packing = chunking.V2_BLOCK, make=chunking.WordTokens) -> None:  # noqa: ANN001
        self.packing, self.make = packing, make

    def ingest(self, pages: DataFrame | None, blocks: DataFrame | None = None) -> IngestionResult:
        if blocks is None:
            raise ValueError("v2-block needs blocks")
        some = blocks.where("source IS NOT NULL AND page_number IS NOT NULL").withColumn("content", clean_lines(F.col("content")))
        b = staged(layout.without_margins(staged(some.where("content <> ''")), page_numbers=False))
        p = layout.reassemble(b, "source", "page_number")
        main = bibliography.main_pages(p)
        kept = b.join(main.select("source", "page_number"), ["source", "page_number"], "left_semi")
        kept = staged(layout.renumbered(layout.split_inline_headings(layout.clean_blocks(kept))))
        typed = layout.sections(staged(layout.classify(layout.until_references(kept))))
        chunks = chunking.chunk_v2_block(typed, self.packing, self.make)
        return IngestionResult(self.name, p, main, bibliography.references(p), _chunks(chunks, embedded=True, parents=True), typed)
