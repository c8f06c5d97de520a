"""Inputs of the queries, each record once, and the pieces of SQL that the counterparts share."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.orphans import source_key
from marginalia.sources.tables import once, read


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return once(read(spark, sf, "doc_pages", ["page_id", "source", "page_number", "content"]), "page_id")


def blocks(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    b = once(read(spark, sf, "blocks", ["block_id", "source", "page_number", "block_index", "content", *more]), "block_id")
    return b.withColumnRenamed("block_index", "pos")


def chunks(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return once(read(spark, sf, "chunks", ["chunk_id", "source", "page_number", "chunk_index", "content", *more]), "chunk_id")


def evidence(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return once(read(spark, sf, "evidence", ["ev_id", "query_id", "source", "page_number", "content", *more]), "ev_id")


def refs(spark: SparkSession, sf: str) -> DataFrame:
    """source (its key), number, content: of several records of a number the one ingested last counts."""
    r = once(read(spark, sf, "refs", ["ref_id", "source", "number", "content", "ingested_at"]), "ref_id").where("source IS NOT NULL AND number IS NOT NULL")
    return r.groupBy(source_key(F.col("source")).alias("source"), "number").agg(F.max_by("content", F.struct("ingested_at", "ref_id")).alias("content"))


WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_squeeze(x: str) -> str:
    return s_strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def s_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def s_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}+')"


def s_key(x: str) -> str:
    return rf"regexp_replace(lower({s_strip(x)}), '\.pdf$', '')"


PAGES = "pg AS (SELECT DISTINCT page_id, source, page_number, content FROM doc_pages WHERE page_id IS NOT NULL)"
BLOCKS = "bl AS (SELECT DISTINCT block_id, source, page_number, block_index AS pos, content, content_type, section_title, x0, y0, x1, y1, font_size, is_bold, page_height FROM blocks WHERE block_id IS NOT NULL)"
CHUNKS = "ch AS (SELECT DISTINCT chunk_id, source, page_number, page_end, chunk_index, content, section_title, section_path, parent_id FROM chunks WHERE chunk_id IS NOT NULL)"
EVIDENCE = "ev AS (SELECT DISTINCT ev_id, query_id, source, page_number, content, reference_numbers FROM evidence WHERE ev_id IS NOT NULL)"
REFS = f"rf AS (SELECT {s_key('source')} AS source, number, arg_max(content, (ingested_at, ref_id)) AS content FROM (SELECT DISTINCT ref_id, source, number, content, ingested_at FROM refs) r WHERE source IS NOT NULL AND number IS NOT NULL AND ref_id IS NOT NULL GROUP BY 1, 2)"


def _compatible() -> str:
    """Characters whose compatible form isn't their canonical one, with that form, as rows of SQL."""
    rows = []
    for o in range(0xA0, sys.maxunicode + 1):
        c = chr(o)
        if unicodedata.decomposition(c).startswith("<") or unicodedata.normalize("NFKD", c) != unicodedata.normalize("NFD", c):
            rows.append("('" + c + "', '" + unicodedata.normalize("NFKD", c).replace("'", "''") + "')")
    return ", ".join(rows)


def s_nfkc(source: str, key: str, out: str) -> str:
    """CTE ``out`` (key, content): the NFKC form of the contents of ``source``. DuckDB has NFC only, so compatible
    characters are replaced first, one row a character."""
    return f"""{out}_k(k, v) AS (VALUES {_compatible()}),
{out}_c AS (SELECT {key}, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT {key}, regexp_extract_all(content, '(?s).') AS l FROM {source} WHERE regexp_matches(content, '[^\x00-\x7f]'))),
{out} AS (SELECT {key}, nfc_normalize(string_agg(coalesce(v, c), '' ORDER BY i)) AS content FROM {out}_c LEFT JOIN {out}_k ON c = k GROUP BY {key} UNION ALL SELECT {key}, content FROM {source} WHERE NOT coalesce(regexp_matches(content, '[^\x00-\x7f]'), false))"""


def s_paragraphs(x: str) -> str:
    return f"""list_filter(list_transform(string_split_regex({x}, '\n{WS}*\n'), lambda x: {s_strip("regexp_replace(replace(x, chr(10), ' '), '[ \t]+', ' ', 'g')")}), lambda x: x <> '')"""


def s_dehyphenate(x: str) -> str:
    once = f"regexp_replace({x}, '({WORD})-{WS}*\\n{WS}*({WORD})', '\\1\\2', 'g')"
    return f"regexp_replace({once}, '({WORD})-{WS}*\\n{WS}*({WORD})', '\\1\\2', 'g')"


def s_clean(x: str) -> str:
    """The clean form of a text in NFKC."""
    return f"array_to_string({s_paragraphs(s_dehyphenate(f'regexp_replace({x}, chr(13) || chr(10) || chr(63), chr(10), chr(103))'))}, chr(10) || chr(10))"
