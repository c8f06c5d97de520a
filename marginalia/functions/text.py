"""Text expressions on columns. All are built-in functions, so they stay inside generated code.

Java's ``\\w``, ``\\s`` and ``\\b`` know ASCII only; every pattern that needs them says ``(?U)``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# publishers' banners that are taken out of extracted text.
BANNERS = [
    r"(?is)^\s*\d{6,}\s*,\s*\d+\s*,\s*Downloaded from\s+https?://.*?Creative Commons License\s*",
    r"(?i)Global Journal of Engineering and Technology Advances\s*,?\s*\d{4}\s*,?\s*\d+\s*\(\d+\)\s*,?\s*\d+\s*[–-]\s*\d+\s*\d*",
]
# A text that is nothing but a page number.
PAGE_NUMBER = r"(?i)^\s*(?:page\s+)?\d+(?:\s+of\s+\d+)?\s*$"
PAGE_NUMBER_BLOCK = r"(?i)^(\d+|page\s+\d+(\s+of\s+\d+)?|\d+\s+of\s+\d+)$"


def strip(c: Column) -> Column:
    """White space of any kind taken off both ends (``trim`` knows only spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def tokens(c: Column) -> Column:
    """Lower-cased runs of word characters of any script (signs like fractions are none)."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))


def clean_noise(c: Column) -> Column:
    """Banners out, blanks squeezed, at most one blank line; '' for a page number, null or empty text."""
    t = F.coalesce(c, F.lit(""))
    for p in BANNERS:
        t = F.regexp_replace(t, p, "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n[ \t]+", "\n")
    t = strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))
    return F.when(t.rlike(PAGE_NUMBER), "").otherwise(t)


def is_page_number(c: Column) -> Column:
    return F.coalesce(squeeze(c).rlike(PAGE_NUMBER_BLOCK), F.lit(False))


def dehyphenate(c: Column) -> Column:
    """Words broken across lines at a hyphen are joined."""
    return F.regexp_replace(c, r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")


def paragraphs(c: Column) -> Column:
    """Paragraphs between blank lines, each on one line, empty ones dropped."""
    p = F.transform(F.split(c, r"(?U)\n\s*\n"), lambda x: strip(F.regexp_replace(F.regexp_replace(x, r"\n", " "), r"[ \t]+", " ")))
    return F.filter(p, lambda x: x != "")


def normalize_paragraphs(c: Column) -> Column:
    return F.array_join(paragraphs(c), "\n\n")


def sentences_loose(c: Column) -> Column:
    """Split after . ! ? and white space."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip), lambda x: x != "")


def sentences_strict(c: Column) -> Column:
    """Split after . ! ? and white space where an ASCII capital or digit follows."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])"), strip), lambda x: x != "")


def margin_signature(c: Column) -> Column:
    """What running lines have in common: lower case, digits masked, blanks squeezed."""
    return squeeze(F.regexp_replace(F.lower(c), r"\d+", "<n>"))


def normalize_heading(c: Column) -> Column:
    return F.regexp_replace(squeeze(c), r"\.+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Common share of the sets of lower-cased words; 0 if either is empty."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFKC; the JVM's functions have no such form. Batches go through Arrow."""
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_text(c: Column) -> Column:
    """NFKC, broken words joined, paragraphs normalised. A text of ASCII only skips Python."""
    t = F.when(c.rlike(r"[^\x00-\x7f]"), nfkc(c)).otherwise(c)
    return normalize_paragraphs(dehyphenate(F.regexp_replace(t, r"\r\n?", "\n")))


def clean_lines(c: Column) -> Column:
    """NFKC, each line squeezed, blank lines dropped; lines stay lines."""
    t = F.when(c.rlike(r"[^\x00-\x7f]"), nfkc(c)).otherwise(c)
    lines = F.transform(F.split(t, "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def embedding_text(content: Column, path: Column) -> Column:
    """What is embedded: the section path before the content, where there is one."""
    return F.when(F.size(F.coalesce(path, F.array())) > 0, F.concat(F.lit("Section: "), F.array_join(path, " > "), F.lit("\n\n"), content)).otherwise(content)


def text_to_embed(embedding: Column, content: Column) -> Column:
    return F.coalesce(F.nullif(embedding, F.lit("")), content)
