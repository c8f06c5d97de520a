"""Chunkers: packing of units under a budget with overlap. Packing is sequential, so what is independent
is folded on its own: a page in v1, a section in v2. Folds run over sorted partitions and hold one chunk
at a time, whatever the length of a section.

Sizes are counted, and too long texts cut, by a pluggable tokenizer; the default knows words of any script.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import strip, word_count
from marginalia.operators import layout
from marginalia.session import staged

_token = re.compile(r"(?:\w+|[^\w\s])\s*")
_loose, _strict = re.compile(r"(?<=[.!?])\s+"), re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")
_blank = re.compile(r"\n\s*\n")
# Headings among paragraphs.
NUMBERED = r"^(\d+(?:\.\d+){0,3})[.)]?\s+(.+)$"
KNOWN = r"(?i)^(?:Abstract|Introduction|Background|Methods?|Methodology|Results?|Discussion|Conclusion|Conclusions|Future Work|Future Directions|Limitations)$"
HEADING_WORDS = 18

CHUNK = "source string, page_number int, page_end int, chunk_index int, content string, section_title string, section_path array<string>, token_count int"


class Tokenizer(Protocol):
    """``additive``: the size of texts joined by spaces is the sum of their sizes, so that nothing is counted twice."""

    additive: bool

    def encode(self, text: str) -> list: ...

    def decode(self, tokens: list) -> str: ...


class WordTokens:
    """The default: words of any script and single signs, each with the white space behind it."""

    additive = True

    def encode(self, text: str) -> list[str]:
        return _token.findall(text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)


def token_windows(text: str, size: int, tok: Tokenizer) -> list[str]:
    """Cuts of at most ``size`` tokens, stripped; blank ones are dropped."""
    t = tok.encode(text)
    cuts = (tok.decode(t[i : i + size]).strip() for i in range(0, len(t), size))
    return [c for c in cuts if c]


# --- v1: words, page by page


def check_words(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("the size must be positive and the overlap less than it")


def pack_words(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs (long ones by sentence, long sentences by windows) packed into ``size`` words; each
    chunk repeats the last ``overlap`` words of the one before."""
    check_words(size, overlap)
    units: list[list[str]] = []
    for p in _blank.split(text):
        w = p.split()
        if len(w) <= size:
            units += [w] if w else []
            continue
        for s in _loose.split(p.strip()):
            w = s.split()
            units += [w[i : i + size] for i in range(0, len(w), size)]
    out: list[str] = []
    held: list[str] = []
    for u in units:
        if held and len(held) + len(u) > size:
            out.append(" ".join(held))
            held = held[-overlap:] if overlap else []
        held = held + u
        while len(held) > size:
            out.append(" ".join(held[:size]))
            held = held[size - overlap :]
    if held:
        out.append(" ".join(held))
    return out


# --- v2: tokens with sections


@dataclass(frozen=True)
class Unit:
    text: str
    page: int
    size: int


@dataclass(frozen=True)
class Chunk:
    units: tuple[Unit, ...]
    size: int

    @property
    def text(self) -> str:
        return join(self.units)


def join(units: tuple[Unit, ...] | list[Unit]) -> str:
    return " ".join(u.text for u in units)


@dataclass(frozen=True)
class Packing:
    target: int
    least: int
    most: int
    overlap_units: int = 1
    overlap_most: int = 40
    check_first: bool = False  # the target is checked for a unit that comes to an empty buffer too


def _sized(units: list[Unit] | tuple[Unit, ...], tok: Tokenizer) -> int:
    """Size of the units' joined text."""
    return sum(u.size for u in units) if tok.additive else len(tok.encode(join(units)))


def _overlap(units: list[Unit], p: Packing, tok: Tokenizer) -> list[Unit]:
    last = units[-p.overlap_units :] if p.overlap_units > 0 else []
    return last if last and _sized(last, tok) <= p.overlap_most else []


class Packer:
    """Packs the units of one section, as they come, up to the target. ``first``: the buffer wasn't empty before,
    so that the first unit is checked too.

    Sizes are of the joined text. After a chunk that reached the target the overlap opens the next; at the
    section's end it is emitted although nothing followed."""

    def __init__(self, p: Packing, tok: Tokenizer, *, first: bool = False) -> None:
        self.p, self.tok, self.first = p, tok, first
        self.held: list[Unit] = []
        self.size = 0

    def _grown(self, u: Unit) -> int:
        return self.size + u.size if self.tok.additive else _sized([*self.held, u], self.tok)

    def _emit(self) -> Chunk:
        out = Chunk(tuple(self.held), self.size)
        self.held = _overlap(self.held, self.p, self.tok)
        self.size = _sized(self.held, self.tok) if self.held else 0
        return out

    def add(self, u: Unit) -> list[Chunk]:
        out = []
        check = self.p.check_first or bool(self.held) or self.first
        self.first = False
        size = self._grown(u)
        if self.held and size > self.p.most:
            out.append(self._emit())
            size = self._grown(u)
            if self.held and size > self.p.most:
                self.held, self.size = [], 0
                size = self._grown(u)
        self.held, self.size = [*self.held, u], size
        if check and size >= self.p.target:
            out.append(self._emit())
        return out

    def rest(self) -> list[Chunk]:
        """The last chunk, if anything is left."""
        return [Chunk(tuple(self.held), self.size)] if self.held else []


class Merger:
    """Lets a chunk below ``least`` join the one before it in its section if both fit into ``most``."""

    def __init__(self, p: Packing, tok: Tokenizer) -> None:
        self.p, self.tok = p, tok
        self.last: Chunk | None = None

    def add(self, c: Chunk) -> list[Chunk]:
        if self.last is not None and c.size < self.p.least:
            both = self.last.units + c.units
            size = self.last.size + c.size if self.tok.additive else _sized(both, self.tok)
            if size <= self.p.most:
                self.last = Chunk(both, size)
                return []
        done, self.last = self.last, c
        return [done] if done is not None else []

    def rest(self) -> list[Chunk]:
        return [self.last] if self.last is not None else []


def pack_units(units: Iterable[Unit], p: Packing, tok: Tokenizer, *, first: bool = False) -> list[Chunk]:
    packer = Packer(p, tok, first=first)
    return [c for u in units for c in packer.add(u)] + packer.rest()


def merge_small(chunks: Iterable[Chunk], p: Packing, tok: Tokenizer) -> list[Chunk]:
    merger = Merger(p, tok)
    return [c for x in chunks for c in merger.add(x)] + merger.rest()


def heading(paragraph: Column) -> Column:
    """The heading that a paragraph is, as "number title" or a known name; else null."""
    t = strip(paragraph)
    number, title = F.regexp_extract(t, f"(?U){NUMBERED}", 1), strip(F.regexp_extract(t, f"(?U){NUMBERED}", 2))
    of = F.when(number != "", F.concat(number, F.lit(" "), title)).when(t.rlike(KNOWN), t)
    return F.when((t != "") & (word_count(t) <= HEADING_WORDS), of)


def cut_units(text: str, page: int, most: int, tok: Tokenizer, *, whole: bool) -> list[Unit]:
    """Units of a paragraph: itself if it fits (``whole``), else its sentences (any white space after a
    mark), or always its sentences (a capital or digit must follow); too long ones in windows."""
    out: list[Unit] = []

    def add(t: str) -> None:
        n = len(tok.encode(t))
        if n <= most:
            out.append(Unit(t, page, n))
        else:
            out.extend(Unit(x, page, len(tok.encode(x))) for x in token_windows(t, most, tok))

    t = text.strip()
    if whole and t and len(tok.encode(t)) <= most:
        add(t)
    else:
        for s in (_loose if whole else _strict).split(t):
            if s.strip():
                add(s.strip())
    return out


V1_SIZE, V1_OVERLAP = 500, 75
V2 = Packing(target=220, least=100, most=320)
V2_BLOCK = replace(V2, check_first=True)


def _frame(rows: list[tuple], columns: str = CHUNK) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in columns.split(", ")])


def chunk_v1(pages: DataFrame, size: int = V1_SIZE, overlap: int = V1_OVERLAP) -> DataFrame:
    """Word chunks of pages (source, page_number, content), never across pages. Pages are packed on
    their own, in any task; only the running index needs the counts of a source's pages before."""
    check_words(size, overlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, p, p, i, c, None, [], len(c.split())) for s, p, t in b[["source", "page_number", "content"]].itertuples(index=False) for i, c in enumerate(pack_words(t, size, overlap))]
            yield _frame(rows)

    packed = staged(pages.where("source IS NOT NULL AND page_number IS NOT NULL AND content IS NOT NULL").select("source", "page_number", "content").mapInPandas(run, CHUNK))
    counts = packed.groupBy("source", "page_number").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "page_number", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("before"))
    return packed.join(counts, ["source", "page_number"]).withColumn("chunk_index", F.col("chunk_index") + F.col("before")).drop("before")


def _check(p: Packing) -> None:
    if p.target <= 0 or p.least <= 0 or p.most <= p.target or p.least > p.target:
        raise ValueError("sizes must be positive, the least at most the target, and the most above it")


def chunk_v2_basic(pages: DataFrame, packing: Packing = V2, make: Callable[[], Tokenizer] = WordTokens) -> DataFrame:
    """Token chunks of pages (source, page_number, content) with sections found among the paragraphs: a
    heading opens a section and isn't part of the text. A chunk ends where the title changes."""
    _check(packing)
    p = pages.where("source IS NOT NULL AND page_number IS NOT NULL AND content IS NOT NULL")
    # Only outer white space goes from a paragraph; the pages' loader has squeezed the rest.
    paras = F.filter(F.transform(F.split("content", r"(?U)\n\s*\n"), strip), lambda x: x != "")
    p = p.select("source", "page_number", F.posexplode(paras).alias("pos", "content"))
    p = p.withColumn("heading", heading(F.col("content"))).withColumn("kind", F.when(F.col("heading").isNotNull(), "heading").otherwise("prose"))
    b = layout.sections(staged(p.withColumn("content", F.coalesce("heading", "content"))), normalized=False)
    return _chunks(b.where("kind = 'prose'"), "section", packing, make, whole=True)


def chunk_v2_block(blocks: DataFrame, packing: Packing = V2_BLOCK, make: Callable[[], Tokenizer] = WordTokens) -> DataFrame:
    """Token chunks of typed blocks (kind, path, section, head): prose only, always by sentence. A chunk
    ends where the section path changes."""
    b = blocks.where("kind = 'prose' AND source IS NOT NULL AND page_number IS NOT NULL AND content IS NOT NULL")
    return _chunks(b, "path", packing, make, whole=False)


def _chunks(prose: DataFrame, key: str, packing: Packing, make: Callable[[], Tokenizer], *, whole: bool) -> DataFrame:
    """Chunks of prose (source, page_number, pos, content, section, path, head). A chunk never crosses a change
    of ``key``, so each stretch of equal keys is packed on its own and a document is no single task."""
    b = staged(prose.where(strip(F.col("content")) != "").select("source", "page_number", "pos", "content", "section", "path", "head"))
    # Headings with prose under them; those whose key equals the one before carry on its stretch.
    used = b.groupBy("source", "head").agg(F.first(key).alias("key"), F.first("section").alias("title"), F.first("path").alias("names"))
    w = Window.partitionBy("source").orderBy("head")
    used = used.withColumn("new", (~F.col("key").eqNullSafe(F.lag("key").over(w)) | F.lag("head").over(w).isNull()).cast("int"))
    used = used.select("source", "head", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))
    b = b.join(used, ["source", "head"])

    columns = CHUNK + ", stretch int, checked int, open0 int, open1 int"
    names = [c.split(" ")[0] for c in columns.split(", ")]

    class Section:
        """The fold over one stretch; holds no more than the chunk being packed and the one before."""

        def __init__(self, source: str, stretch: int, section: str | None, path: object, tok: Tokenizer) -> None:
            self.of, self.stretch, self.tok = (source, section, path), stretch, tok
            self.ways: list[tuple[Packer, Merger]] = []
            self.n = [0, 0]

        def _rows(self, way: int, chunks: list[Chunk]) -> Iterator[tuple]:
            for c in chunks:
                pages = [u.page for u in c.units]
                yield self.of[0], min(pages), max(pages), self.n[way], c.text, self.of[1], self.of[2], c.size, self.stretch, way if len(self.ways) > 1 else None, None, None
                self.n[way] += 1

        def add(self, u: Unit) -> Iterator[tuple]:
            if not self.ways:
                # Whether a large first unit is checked depends on the section before: both ways are packed.
                firsts = (False, True) if not packing.check_first and u.size >= packing.target else (False,)
                self.ways = [(Packer(packing, self.tok, first=f), Merger(packing, self.tok)) for f in firsts]
            for way, (packer, merger) in enumerate(self.ways):
                for c in packer.add(u):
                    yield from self._rows(way, merger.add(c))

        def end(self) -> Iterator[tuple]:
            left = []
            for way, (packer, merger) in enumerate(self.ways):
                rest = packer.rest()
                left.append(int(bool(rest)))
                for c in rest:
                    yield from self._rows(way, merger.add(c))
                yield from self._rows(way, merger.rest())
            if self.ways:
                yield self.of[0], None, None, None, None, None, None, None, self.stretch, None, left[0], left[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, now, at = make(), None, None
        for batch in batches:
            rows: list[tuple] = []
            for source, stretch, page, text, section, path in batch[["source", "stretch", "page_number", "content", "section", "path"]].itertuples(index=False, name=None):
                if at != (source, stretch):
                    rows += now.end() if now else []
                    now, at = Section(source, stretch, section, path, tok), (source, stretch)
                for u in cut_units(text, page, packing.most, tok, whole=whole):
                    rows += now.add(u)
            yield pd.DataFrame(rows, columns=names)
        if now:
            yield pd.DataFrame(list(now.end()), columns=names)

    parts = int(b.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = staged(b.repartition(parts, "source", "stretch").sortWithinPartitions("source", "stretch", "page_number", "pos").mapInPandas(run, columns))
    w = Window.partitionBy("source").orderBy("stretch")
    # A section leaves a rest behind whatever came before, or (alone) exactly if the one before didn't.
    counts = packed.groupBy("source", "stretch").agg(F.max("open0").alias("open0"), F.max("open1").alias("open1"), F.count_if(F.col("content").isNotNull() & (F.coalesce("checked", F.lit(0)) == 0)).alias("n0"), F.count_if(F.col("content").isNotNull() & (F.coalesce("checked", F.lit(1)) == 1)).alias("n1"))
    ends = counts.withColumn("turns", F.sum((F.col("open0") > F.col("open1")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    settled = F.when(F.col("open0") == F.col("open1"), F.struct("open0", "turns"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("at", F.last(settled, ignorenulls=True).over(before)).withColumn("turned", F.coalesce(F.lag("turns").over(w), F.lit(0)))
    ends = ends.withColumn("way", F.pmod(F.coalesce("at.open0", F.lit(0)) + F.col("turned") - F.coalesce("at.turns", F.lit(0)), F.lit(2)))
    ends = ends.withColumn("n", F.when(F.col("way") == 1, F.col("n1")).otherwise(F.col("n0")))
    ends = ends.select("source", "stretch", "way", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("before"))
    out = packed.where("content IS NOT NULL").join(ends, ["source", "stretch"]).where(F.coalesce("checked", "way") == F.col("way"))
    return out.withColumn("chunk_index", F.col("chunk_index") + F.col("before")).select(*[c.split(" ")[0] for c in CHUNK.split(", ")])
