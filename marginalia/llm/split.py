"""Splitting oversized items at natural boundaries by agglomerative merging.

An item is first cut into atoms (words, or single signs of scripts without spaces). The
boundaries between neighbours wait in a heap; the weakest are merged first (between words, then
clauses, sentences, lines, paragraphs; of equal ones, the pair that is smallest together), as long
as the merged piece with its overlap fits the limit. What is left are the pieces, so cuts fall on
the strongest boundaries that the limit allows.

A unit is one sign of U+0E00-0E7F, U+3040-30FF or U+3400-9FFF, or a longest run of other
characters without white space; an atom is one unit, so every item can be cut.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ALONE = "฀-๿぀-ヿ㐀-鿿"
#: White space as the units mean it, the same on both sides of Arrow.
_SPACE = "\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = f"[{_ALONE}]|[^{_SPACE}{_ALONE}]+"
_unit = re.compile(UNIT)
_ends_sentence = re.compile("[.!?…。！？।؟]+[\"'”’»)\\]」』）]*$")
_ends_clause = re.compile("[,;:、，；：،–—][\"'”’»)\\]」）]*$")
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 5, 4, 3, 2, 1, 0


def units(c: Column) -> Column:
    """Number of units of a text; null for null."""
    return F.regexp_count(c, F.lit(UNIT))


def boundary(before: str, gap: str) -> int:
    """Strength of the boundary after ``before`` with white space ``gap``."""
    lines = gap.count("\n")
    if lines > 1:
        return PARAGRAPH
    if _ends_sentence.search(before):
        return LINE if lines else SENTENCE
    if lines:
        return CLAUSE
    if _ends_clause.search(before):
        return CLAUSE
    return WORD if gap else INSIDE


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, core, end) of each piece as offsets: it holds text[start:end], of which
    text[start:core] repeats the last ``overlap`` units of what comes before."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    spans = [m.span() for m in _unit.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, 0, len(text))] if n else []
    strength = [boundary(text[max(a, b - 6) : b], text[b : spans[i + 1][0]]) for i, (a, b) in enumerate(spans[:-1])]
    # Segment i is known by its first atom; right[i] is the atom after its last one.
    right = list(range(1, n + 1))
    left = [i - 1 for i in range(n)]
    alive = [True] * n
    heap = [(s, 2, i) for i, s in enumerate(strength)]
    heapq.heapify(heap)
    while heap:
        s, size, i = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = right[i]
        if j >= n or right[j] - i != size:
            continue  # a later entry stands for this pair
        if size + (overlap if i else 0) > limit:
            continue  # sizes only grow, so this pair never fits again
        right[i], alive[j] = right[j], False
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (strength[right[i] - 1], right[right[i]] - i, i))
        if i:
            heapq.heappush(heap, (strength[i - 1], right[i] - left[i], left[i]))
    out, i = [], 0
    while i < n:
        j = right[i]
        start = spans[max(0, i - overlap)][0] if i else 0
        out.append((start, spans[i][0] if i else 0, spans[j][0] if j < n else len(text)))
        i = j
    return out


def split_items(df: DataFrame, id_column: str, column: str, limit: int, overlap: int) -> DataFrame:
    """Pieces of every item: (id, piece, start_pos, core_pos, end_pos, units, content).

    Positions count code points from 1, end_pos inclusive. The cores of an item's pieces, put
    together, are the item. An item within the limit is one piece; whatever a size column
    says is ignored. Null ids and null, empty or blank texts have no piece.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["text"], strict=True):
                for k, (start, core, end) in enumerate(pieces(text, limit, overlap)):
                    part = text[start:end]
                    rows.append((key, k, start + 1, core + 1, end, len(_unit.findall(part)), part))
            yield pd.DataFrame(rows, columns=["id", "piece", "start_pos", "core_pos", "end_pos", "units", "content"])

    some = df.select(F.col(id_column).alias("id"), F.col(column).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return some.mapInPandas(run, "id bigint, piece int, start_pos int, core_pos int, end_pos int, units int, content string")


def oversized(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Rows whose text is above the limit; the length in characters spares most the counting."""
    return df.where((F.length(column) > limit) & (units(F.col(column)) > limit))
