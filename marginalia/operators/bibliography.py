"""Bibliographies: where they start, their entries, and the store of entries by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import strip
from marginalia.operators.running import running

# The heading of a bibliography with its first entry, and the marks of entries.
CUT = r"(?i)\bReferences\s*(?=(?:\[\d+\]|\d+[.)]))"
HEADING = r"(?i)\bReferences\s*(?=(?:\[\d+\]|\d+[.)]\s))"
BRACKETED = r"(?s)\[(\d+)\]\s+(.*?)(?=\s*\[\d+\]\s+|\z)"
PLAIN = r"(?<!\d)\d{1,3}[.)]\s+"
FOOTERS = [
    r"(?is)\s+\d+\s+of\s+\d+\s+(?:Advanced Intelligent Discovery|Global Journal.*?)?$",
    r"(?is)\s+\d+\s+of\s+\d+\s+\d+,\s*\d+,\s*Downloaded from.*$",
    r"(?is)\s+\d+,\s*\d+,\s*Downloaded from.*$",
]


def main_pages(pages: DataFrame) -> DataFrame:
    """Pages before the bibliography; the page where it starts is cut there, and dropped if nothing is left."""
    at = F.regexp_instr(F.col("content"), F.lit(CUT))
    marked = pages.withColumn("at", at)
    cut = marked.where("at > 0").groupBy("source").agg(F.min("page_number").alias("cut"))
    p = marked.join(cut, "source", "left").where("cut IS NULL OR page_number <= cut")
    p = p.withColumn("content", F.when(F.col("page_number") == F.col("cut"), strip(F.expr("substring(content, 1, at - 1)"))).otherwise(F.col("content")))
    return p.where((F.col("cut").isNull()) | (F.col("page_number") < F.col("cut")) | (strip(F.col("content")) != "")).drop("at", "cut")


def bibliography_text(text: Column) -> Column:
    """What follows the bibliography's heading; null without one."""
    at = F.regexp_instr(text, F.lit(HEADING))
    rest = F.substring(text, at, F.length(text))
    return F.when(at > 0, F.regexp_replace(rest, r"(?i)^References\s*", ""))


def bracketed(text: Column) -> Column:
    """array<struct<number, content>> of entries ``[n] ...``."""
    n = F.regexp_extract_all(text, F.lit(BRACKETED), F.lit(1))
    c = F.regexp_extract_all(text, F.lit(BRACKETED), F.lit(2))
    return F.filter(F.zip_with(n, c, lambda x, y: F.struct(x.cast("int").alias("number"), strip(y).alias("content"))), lambda e: e["content"] != "")


def clean_entry(c: Column) -> Column:
    """Page footers off the end of an entry."""
    t = strip(c)
    for p in FOOTERS:
        t = F.regexp_replace(t, p, "")
    return strip(t)


def entries(texts: DataFrame) -> DataFrame:
    """source, number, content of the entries in whole texts (source, text): the bracketed style if it gives any,
    else the plain one. Entries without content are left out; texts without a bibliography give none.

    Plain marks count only in sequence: a mark whose number isn't the next expected one belongs to the entry
    before. One fold keeps the places of those that count; the contents are cut from the pieces between marks.
    """
    t = texts.withColumn("_b", bibliography_text(F.col("text"))).where("_b IS NOT NULL").withColumn("_bracketed", bracketed(F.col("_b")))
    # Steps of their own: what is used at several places is computed once.
    t = t.withColumn("_plain", F.when(F.size("_bracketed") == 0, F.col("_b")))
    t = t.withColumns({"_marks": F.regexp_extract_all("_plain", F.lit(PLAIN), F.lit(0)), "_gaps": F.split("_plain", PLAIN, -1)})
    t = t.withColumns({"_n": F.transform("_marks", lambda m: F.regexp_extract(m, r"\d+", 0).cast("int")), "_pieces": F.zip_with("_marks", F.slice("_gaps", 2, F.size("_gaps")), lambda m, x: F.concat(m, x))})
    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("kept"))

    def step(acc, n):  # noqa: ANN001, ANN202
        fits = n == acc["next"]
        return F.struct(F.when(fits, acc["next"] + 1).otherwise(acc["next"]).alias("next"), (acc["i"] + 1).alias("i"), F.when(fits, F.concat(acc["kept"], F.array(acc["i"]))).otherwise(acc["kept"]).alias("kept"))

    t = t.withColumn("_kept", F.aggregate("_n", start, step, lambda acc: acc["kept"]))
    # Entry k runs from the k-th mark kept to the next one kept.
    t = t.withColumn("_cuts", F.transform("_kept", lambda at, k: F.struct((k + 1).alias("number"), at.alias("at"), F.coalesce(F.get("_kept", k + 1), F.size("_marks")).alias("end"))))
    content = lambda c: clean_entry(F.concat(F.get("_gaps", c["at"] + 1), F.array_join(F.slice("_pieces", c["at"] + 2, c["end"] - c["at"] - 1), "")))
    in_order = F.transform("_cuts", lambda c: F.struct(c["number"].alias("number"), content(c).alias("content")))
    both = F.when(F.size("_bracketed") > 0, F.col("_bracketed")).otherwise(in_order)
    return t.select("source", F.explode(both).alias("e")).select("source", "e.number", "e.content").where("content <> ''")


def bibliography_texts(pages: DataFrame) -> DataFrame:
    """source, text: the pages from the one where the bibliography starts, joined by line breaks.

    The heading may stand at the end of a page and its first entry on the next one. Only pages from there on
    are put together; the places are found by narrow running values, not by sorting whole pages.
    """
    p = pages.where("source IS NOT NULL AND page_number IS NOT NULL AND content IS NOT NULL").select("source", "page_number", "content")
    m = p.select("source", "page_number", (-F.col("page_number")).alias("back"), F.regexp_instr("content", F.lit(HEADING)).alias("at"), F.regexp_extract("content", r"(?i)\bReferences\s*\z", 0).alias("tail"), F.substring("content", 1, 64).alias("head"))
    m = running(m, {"next": ("last", F.col("head"))}, ("back",), inclusive=False)
    here = (F.col("at") > 0) | ((F.col("tail") != "") & F.concat(F.col("tail"), F.lit("\n"), F.coalesce("next", F.lit(""))).rlike(HEADING))
    cut = m.where(here).groupBy("source").agg(F.min("page_number").alias("cut"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "content"))), lambda x: x["content"])
    return p.join(cut, "source").where("page_number >= cut").groupBy("source").agg(F.array_join(parts, "\n").alias("text"))


def references(pages: DataFrame) -> DataFrame:
    """source, number, content of the bibliographies of pages (source, page_number, content)."""
    return entries(bibliography_texts(pages))


def stem(source: Column) -> Column:
    """Key of the store: the source's name without its last suffix."""
    return F.regexp_replace(source, r"\.[^.]*$", "")


def latest(refs: DataFrame, order: Column) -> DataFrame:
    """stem, number, content: of repeated numbers the last one counts."""
    r = refs.where(F.col("source").isNotNull() & F.col("number").isNotNull())
    return r.groupBy(stem(F.col("source")).alias("stem"), "number").agg(F.max_by("content", order).alias("content"))


def to_json_maps(refs: DataFrame) -> DataFrame:
    """stem, json: one object {"number": content} a source."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("number"), F.col("content"))))
    return refs.groupBy("stem").agg(F.to_json(F.map_from_entries(F.transform(entries, lambda x: F.struct(x["number"].cast("string"), x["content"])))).alias("json"))


def from_json_maps(maps: DataFrame) -> DataFrame:
    m = F.from_json("json", "map<string,string>")
    return maps.select("stem", F.explode(m).alias("n", "content")).select("stem", F.col("n").cast("int").alias("number"), "content")
