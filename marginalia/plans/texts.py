"""Queries on text cleaning, layout, sections and bibliographies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import bibliography, layout
from marginalia.plans.common import BLOCKS, PAGES, REFS, WS, blocks, pages, refs, s_clean, s_dehyphenate, s_nfkc, s_paragraphs, s_squeeze, s_strip
from marginalia.session import staged

_BANNER = "1234567, 89, Downloaded from https://example.org/a?b, see the Creative Commons License "
_JOURNAL = "Global Journal of Engineering and Technology Advances, 2021, 12(3), 10-19 "


def noise_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Banners, blanks and page numbers are put into the contents, since the tables have none."""
    k = F.col("block_id") % 5
    t = F.when(k == 0, F.concat(F.lit(_BANNER), "content")).when(k == 1, F.concat(F.lit(_JOURNAL), "content")).when(k == 2, F.concat(F.lit("  Page "), "page_number", F.lit(" of 90 "))).when(k == 3, F.concat(F.lit("a\n\n\n\n  b\t c "), "content")).otherwise(F.col("content"))
    return blocks(spark, sf).select("block_id", T.clean_noise(t).alias("clean"))


def page_number_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).where(T.is_page_number(F.col("content"))).select("block_id")


def paragraph_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", T.normalize_paragraphs(F.col("content")).alias("clean"))


def dehyphenate(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", T.dehyphenate(F.col("content")).alias("clean"))


def unicode_clean(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", T.clean_text(F.col("content")).alias("clean"))


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", F.posexplode(T.sentences_strict(F.col("content"))).alias("n", "sentence"))


def margin_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return layout.margin_signatures(blocks(spark, sf, "y0", "y1", "page_height"))


def margin_filtered_pages(spark: SparkSession, sf: str) -> DataFrame:
    b = layout.without_margins(blocks(spark, sf, "y0", "y1", "page_height"))
    return layout.reassemble(b, "source", "page_number").select("source", "page_number", F.md5("content").alias("digest"), F.length("content").alias("n_chars"))


def body_font_median(spark: SparkSession, sf: str) -> DataFrame:
    return layout.body_font_size(blocks(spark, sf, "font_size"))


def classify_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return layout.classify(blocks(spark, sf, "font_size", "is_bold")).select("block_id", "kind")


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return staged(layout.classify(blocks(spark, sf, "font_size", "is_bold")))


def section_fill(spark: SparkSession, sf: str) -> DataFrame:
    return layout.section_titles(_typed(spark, sf)).select("block_id", "section")


def section_path(spark: SparkSession, sf: str) -> DataFrame:
    return layout.section_paths(_typed(spark, sf)).select("block_id", F.array_join("path", " > ").alias("path"))


def inline_headings(spark: SparkSession, sf: str) -> DataFrame:
    b = blocks(spark, sf).withColumn("content", F.when(F.col("block_id") % 7 == 0, F.concat(F.lit("2.1 Methods of test. "), "content")).otherwise(F.col("content")))
    return layout.split_inline_headings(b).select("block_id", "piece", "content")


def take_until_references(spark: SparkSession, sf: str) -> DataFrame:
    put = (F.col("page_number") % 9 == 8) & (F.col("pos") == 2)
    b = blocks(spark, sf).withColumn("content", F.when(put, " References ").otherwise(F.col("content")))
    return layout.until_references(b).select("block_id")


def _with_bibliography(spark: SparkSession, sf: str) -> DataFrame:
    put = F.col("page_number") % 10 == 7
    return pages(spark, sf).withColumn("content", F.when(put, F.concat("content", F.lit("\nReferences [1] A first entry. [2] A second one."))).otherwise(F.col("content")))


def bibliography_cut(spark: SparkSession, sf: str) -> DataFrame:
    return bibliography.main_pages(_with_bibliography(spark, sf)).select("page_id", F.length("content").alias("n_chars"))


def main_page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    keep = bibliography.main_pages(_with_bibliography(spark, sf)).select("source", "page_number")
    return blocks(spark, sf).join(keep, ["source", "page_number"], "left_semi").select("block_id")


def _bibliographies(spark: SparkSession, sf: str, form: str) -> DataFrame:
    r = refs(spark, sf).where("content IS NOT NULL")
    entry = F.concat(F.format_string(form, "number"), T.squeeze(F.col("content")))
    return r.groupBy("source").agg(F.concat(F.lit("Text before.\nReferences "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", entry.alias("e")))), lambda x: x["e"]), "\n")).alias("text"))


def parse_bracketed_refs(spark: SparkSession, sf: str) -> DataFrame:
    return bibliography.entries(_bibliographies(spark, sf, "[%d] "))


def parse_plain_refs(spark: SparkSession, sf: str) -> DataFrame:
    return bibliography.entries(_bibliographies(spark, sf, "%d. "))


def latest_refs(spark: SparkSession, sf: str) -> DataFrame:
    return refs(spark, sf)


_KIND = rf"""
CASE WHEN t.s SIMILAR TO '(?s).*' AND regexp_matches(t.s, '{layout.TABLE}') THEN 'table'
 WHEN regexp_matches(t.s, '{layout.FIGURE}') THEN 'figure_caption' WHEN regexp_matches(t.s, '{layout.BACK_MATTER}') THEN 'back_matter'
 WHEN page_number = 1 AND regexp_matches(t.s, '{layout.FRONT_MATTER}') THEN 'metadata' WHEN page_number = 1 AND font_size >= body + 2 AND n <= 40 THEN 'title'
 WHEN regexp_matches(t.s, '{layout.NUMBERED_HEADING}') OR regexp_matches(t.s, '{layout.KNOWN_HEADING}') THEN 'heading'
 WHEN n <= 20 AND font_size >= body + 1 THEN 'heading' WHEN n <= 20 AND is_bold AND font_size >= body THEN 'heading' ELSE 'prose' END
""".replace("t.s SIMILAR TO '(?s).*' AND ", "")
_SIG = s_squeeze("regexp_replace(lower(content), '[0-9]+', '<n>', 'g')")
_MARGIN = "coalesce(y1 <= 0.12 * page_height OR y0 >= (1 - 0.12) * page_height, false)"
SIGS = f"""cnt AS (SELECT source, count(DISTINCT page_number) AS p FROM bl GROUP BY source),
sg AS (SELECT source, {_SIG} AS signature, count(DISTINCT page_number) AS pages FROM bl WHERE {_MARGIN} AND {_SIG} <> '' GROUP BY 1, 2),
ms AS (SELECT source, signature, pages FROM sg JOIN cnt USING (source) WHERE pages >= greatest(3, ceil(0.30 * p)))"""
BODY = f"""wc AS (SELECT *, {s_strip("coalesce(content, '')")} AS s, len(list_filter(string_split_regex(coalesce(content, ''), '{WS}+'), lambda w: w <> '')) AS n FROM bl),
bd AS (SELECT source, coalesce(median(font_size) FILTER (WHERE n >= 5), 10.0) AS body FROM wc GROUP BY source),
ty AS (SELECT t.*, {_KIND} AS kind FROM wc t JOIN bd USING (source))"""
HEAD = f"regexp_replace({s_squeeze('content')}, '\\.+$', '')"
_NUMERIC_PAGE = r"(?i)^(\d+|page\s+\d+(\s+of\s+\d+)?|\d+\s+of\s+\d+)$"
MARGIN_KEPT = f"k AS (SELECT * FROM bl WHERE NOT coalesce(regexp_matches({s_squeeze('content')}, '{_NUMERIC_PAGE}'), false) AND NOT ({_MARGIN} AND coalesce((source, {_SIG}) IN (SELECT (source, signature) FROM ms), false)) AND content IS NOT NULL)"
_SQUEEZED = s_strip(r"regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
_CLEAN = f"""
t1 AS (SELECT block_id, CASE block_id % 5 WHEN 0 THEN '{_BANNER}' || content WHEN 1 THEN '{_JOURNAL}' || content WHEN 2 THEN '  Page ' || page_number || ' of 90 ' WHEN 3 THEN 'a' || chr(10) || chr(10) || chr(10) || chr(10) || '  b' || chr(9) || ' c ' || content ELSE content END AS t FROM bl),
t2 AS (SELECT block_id, regexp_replace(regexp_replace(coalesce(t, ''), '{T.BANNERS[0]}', '', 'g'), '{T.BANNERS[1]}', '', 'g') AS t FROM t1),
t3 AS (SELECT block_id, {_SQUEEZED} AS t FROM t2)"""


def cleaned(source: str) -> str:
    """Blocks of ``source`` without banners and page numbers, emptied ones dropped."""
    return f"SELECT block_id, pos, t AS content FROM (SELECT block_id, pos, {_SQUEEZED} AS t FROM (SELECT block_id, pos, regexp_replace(regexp_replace(coalesce(content, ''), '{T.BANNERS[0]}', '', 'g'), '{T.BANNERS[1]}', '', 'g') AS t FROM {source})) WHERE t <> '' AND NOT regexp_matches(t, '{T.PAGE_NUMBER}')"


INLINE_PIECES = f"""il AS (SELECT block_id, pos, list_filter(list_transform(string_split_regex(content, '\\r\\n|\\n|\\r'), lambda x: {s_strip('x')}), lambda x: x <> '') AS lines FROM cb),
ix AS (SELECT block_id, pos, flatten(list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '{layout.INLINE_HEADING}') THEN [{s_strip(f"regexp_extract(x, '{layout.INLINE_HEADING}', 1)")}, {s_strip(f"regexp_extract(x, '{layout.INLINE_HEADING}', 2)")}] ELSE [x] END)) AS ps FROM il),
ip AS (SELECT block_id, CAST(pos AS BIGINT) * 4294967296 + u.i - 1 AS pos, ps[u.i] AS content FROM ix, unnest(range(1, len(ps) + 1)) AS u(i))"""
_CUTPAGES = r"""pb AS (SELECT page_id, source, page_number, CASE WHEN page_number % 10 = 7 THEN content || chr(10) || 'References [1] A first entry. [2] A second one.' ELSE content END AS content FROM pg),
ct AS (SELECT source, min(page_number) AS cut FROM pb WHERE regexp_matches(content, '(?i)\bReferences\s*(\[\d+\]|\d+[.)])') GROUP BY source),
mp AS (SELECT page_id, source, page_number, CASE WHEN page_number = cut THEN """ + s_strip(r"regexp_extract(content, '(?is)^(.*?)\bReferences\s*(?:\[\d+\]|\d+[.)])', 1)") + r""" ELSE content END AS content, cut FROM pb LEFT JOIN ct USING (source) WHERE cut IS NULL OR page_number <= cut),
mn AS (SELECT * FROM mp WHERE cut IS NULL OR page_number < cut OR """ + s_strip("content") + " <> '')"

QUERIES = {
    f.__name__: f
    for f in (
        noise_clean, page_number_blocks, paragraph_normalize, dehyphenate, unicode_clean, sentence_split, margin_signatures, margin_filtered_pages, body_font_median, classify_blocks, section_fill, section_path, inline_headings,
        take_until_references, bibliography_cut, main_page_blocks, parse_bracketed_refs, parse_plain_refs, latest_refs,
    )
}
_W = "WITH "
ORACLES = {
    "noise_clean": _W + BLOCKS + "," + _CLEAN + f" SELECT block_id, CASE WHEN regexp_matches(t, '{T.PAGE_NUMBER}') THEN '' ELSE t END AS clean FROM t3",
    "page_number_blocks": _W + BLOCKS + f" SELECT block_id FROM bl WHERE regexp_matches({s_squeeze('content')}, '{_NUMERIC_PAGE}')",
    "paragraph_normalize": _W + PAGES + f" SELECT page_id, array_to_string({s_paragraphs('content')}, chr(10) || chr(10)) AS clean FROM pg",
    "dehyphenate": _W + PAGES + f" SELECT page_id, {s_dehyphenate('content')} AS clean FROM pg",
    "unicode_clean": _W + PAGES + "," + s_nfkc("pg", "page_id", "nf") + f" SELECT page_id, {s_clean('content')} AS clean FROM nf",
    "parse_plain_refs": "WITH RECURSIVE " + REFS + f""", bt AS (SELECT source, string_agg(number || '. ' || {s_squeeze('content')}, chr(10) ORDER BY number) AS t FROM rf WHERE content IS NOT NULL GROUP BY source),
bh AS (SELECT source, t FROM bt WHERE regexp_matches(t, '^\\d+[.)]{WS}')),
tk AS (SELECT source, regexp_extract_all(t, '[0-9]+|[^0-9]+') AS l FROM bh), ti AS (SELECT source, u.i AS i, l[u.i] AS x, coalesce(l[u.i + 1], '') AS y FROM tk, unnest(range(1, len(l) + 1)) AS u(i)),
mk AS (SELECT source, i, CAST(x AS INTEGER) AS n, length(regexp_extract(y, '^[.)]{WS}+')) AS skip FROM ti WHERE regexp_matches(x, '^[0-9]{{1,3}}$') AND regexp_matches(y, '^[.)]{WS}+')),
kp AS (SELECT source, 1 AS n, min(i) AS i FROM mk WHERE n = 1 GROUP BY source UNION ALL SELECT kp.source, kp.n + 1, (SELECT min(i) FROM mk WHERE mk.source = kp.source AND mk.n = kp.n + 1 AND mk.i > kp.i) FROM kp WHERE kp.i IS NOT NULL),
ke AS (SELECT source, n, i, lead(i) OVER (PARTITION BY source ORDER BY n) AS e FROM kp WHERE i IS NOT NULL),
en AS (SELECT ke.source, ke.n, substr(array_to_string(l[ke.i + 1 : coalesce(ke.e - 1, len(l))], ''), mk.skip + 1) AS c FROM ke JOIN tk USING (source) JOIN mk ON mk.source = ke.source AND mk.i = ke.i)
SELECT source, n AS number, {s_strip('c')} AS content FROM en WHERE {s_strip('c')} <> ''""",
    "sentence_split": _W + PAGES + f", s AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(content, '([.!?]){WS}+([A-Z0-9])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda x: {s_strip('x')}), lambda x: x <> '') AS l FROM pg) SELECT page_id, CAST(i - 1 AS INTEGER) AS n, l[i] AS sentence FROM s, unnest(range(1, len(l) + 1)) AS u(i)",
    "margin_signatures": _W + BLOCKS + "," + SIGS + " SELECT source, signature, pages FROM ms",
    "margin_filtered_pages": _W + BLOCKS + "," + SIGS + ", " + MARGIN_KEPT + " SELECT source, page_number, md5(string_agg(content, chr(10) || chr(10) ORDER BY pos, content)) AS digest, CAST(length(string_agg(content, chr(10) || chr(10) ORDER BY pos, content)) AS INTEGER) AS n_chars FROM k GROUP BY source, page_number",
    "body_font_median": _W + BLOCKS + "," + BODY + " SELECT source, body FROM bd",
    "classify_blocks": _W + BLOCKS + "," + BODY + " SELECT block_id, kind FROM ty",
    "section_fill": _W + BLOCKS + "," + BODY + f" SELECT block_id, last_value(CASE WHEN kind = 'heading' THEN {HEAD} END IGNORE NULLS) OVER (PARTITION BY source ORDER BY page_number, pos ROWS UNBOUNDED PRECEDING) AS section FROM ty",
    "take_until_references": _W + BLOCKS + ", b AS (SELECT *, page_number % 9 = 8 AND pos = 2 AS r FROM bl), c AS (SELECT source, min((page_number, pos)) AS m FROM b WHERE r GROUP BY source) SELECT block_id FROM b LEFT JOIN c USING (source) WHERE m IS NULL OR (page_number, pos) < m",
    "bibliography_cut": _W + PAGES + "," + _CUTPAGES + " SELECT page_id, CAST(length(content) AS INTEGER) AS n_chars FROM mn",
    "main_page_blocks": _W + PAGES + "," + BLOCKS + "," + _CUTPAGES + " SELECT block_id FROM bl WHERE (source, page_number) IN (SELECT (source, page_number) FROM mn)",
    "parse_bracketed_refs": _W + REFS + f" SELECT source, number, {s_squeeze('content')} AS content FROM rf WHERE content IS NOT NULL AND {s_squeeze('content')} <> ''",
    "latest_refs": _W + REFS + " SELECT * FROM rf",
    "section_path": "WITH RECURSIVE " + BLOCKS + "," + BODY + f""", hd AS (SELECT source, page_number, pos, {HEAD} AS h, row_number() OVER (PARTITION BY source ORDER BY page_number, pos) AS k FROM ty WHERE kind = 'heading'),
lv AS (SELECT *, regexp_extract(h, '^(\\d+(?:\\.\\d+)*)', 1) AS num FROM hd),
wp AS (SELECT source, k, [h] AS path FROM lv WHERE k = 1 UNION ALL SELECT lv.source, lv.k, CASE WHEN num = '' THEN [h] ELSE list_append(wp.path[1 : len(string_split(num, '.')) - 1], h) END FROM wp JOIN lv ON lv.source = wp.source AND lv.k = wp.k + 1),
bk AS (SELECT block_id, source, count(*) FILTER (WHERE kind = 'heading') OVER (PARTITION BY source ORDER BY page_number, pos ROWS UNBOUNDED PRECEDING) AS k FROM ty)
SELECT block_id, coalesce(array_to_string(path, ' > '), '') AS path FROM bk LEFT JOIN wp USING (source, k)""",
    "inline_headings": _W + BLOCKS + f""", b AS (SELECT block_id, CASE WHEN block_id % 7 = 0 THEN '2.1 Methods of test. ' || content ELSE content END AS content FROM bl WHERE content IS NOT NULL),
l AS (SELECT block_id, list_filter(list_transform(string_split_regex(content, '\\r\\n|\\n|\\r'), lambda x: {s_strip('x')}), lambda x: x <> '') AS lines FROM b),
p AS (SELECT block_id, flatten(list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '{layout.INLINE_HEADING}') THEN [{s_strip(f"regexp_extract(x, '{layout.INLINE_HEADING}', 1)")}, {s_strip(f"regexp_extract(x, '{layout.INLINE_HEADING}', 2)")}] ELSE [x] END)) AS ps FROM l)
SELECT block_id, CAST(u.i - 1 AS INTEGER) AS piece, ps[u.i] AS content FROM p, unnest(range(1, len(ps) + 1)) AS u(i)""",
}
