"""Queries on the ingestion pipelines: pages and blocks of the tables, with a short bibliography at the end of
each source, to references and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.pipelines import IngestionResult
from marginalia.plans.common import BLOCKS, PAGES, WS, blocks, pages, s_clean, s_nfkc, s_paragraphs, s_squeeze, s_strip
from marginalia.plans.texts import BODY, HEAD, INLINE_PIECES, MARGIN_KEPT, SIGS, cleaned
from marginalia.plugins import create
from marginalia.session import staged

#: Sources whose names have an even number of characters have entries in brackets, others plain ones.
_BRACKETS, _PLAIN = "[1] A first entry, 2001.\n[2] A second one, pp. 3-4.", "1. A first entry, 2001.\n2. A second one, pp. 3-4."
_LAYOUT = ("y0", "y1", "page_height", "font_size", "is_bold")


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = staged(pages(spark, sf))
    ends = p.groupBy("source").agg(F.max("page_number").alias("last"))
    entries = F.when(F.length("source") % 2 == 0, _BRACKETS).otherwise(_PLAIN)
    q = p.join(ends, "source", "left").withColumn("content", F.when(F.col("page_number") == F.col("last"), F.concat("content", F.lit("\n\nEnd of text.\n\nReferences "), entries)).otherwise(F.col("content")))
    b = staged(blocks(spark, sf, *_LAYOUT))
    tail = b.groupBy("source").agg(F.max("page_number").alias("page_number")).where("source IS NOT NULL")
    tail = tail.select("source", "page_number", F.explode(F.array(F.struct(F.lit(100_000).alias("pos"), F.lit("References").alias("content")), F.struct(F.lit(100_001).alias("pos"), entries.alias("content")))).alias("x")).select("source", "page_number", "x.*")
    return q.drop("last"), b.unionByName(tail, allowMissingColumns=True)


def _result(spark: SparkSession, sf: str, name: str) -> IngestionResult:
    p, b = _inputs(spark, sf)
    return create(name).ingest(None if name == "v2-block" else p, None if name == "v1" else b)


def _rows(r: IngestionResult) -> DataFrame:
    return r.chunks.select("source", "page_number", "page_end", "chunk_index", "token_count", "section_title", "content", "parent_id", F.md5("embedding_text").alias("embedded"))


def chunk_v1(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_result(spark, sf, "v1"))


def chunk_v2_basic(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_result(spark, sf, "v2-basic"))


def chunk_v2_block(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_result(spark, sf, "v2-block"))


def pipeline_references(spark: SparkSession, sf: str) -> DataFrame:
    """The references that each pipeline finds."""
    p, b = _inputs(spark, sf)
    out = None
    for name in ("v1", "v2-basic", "v2-block"):
        one = create(name).ingest(None if name == "v2-block" else p, None if name == "v1" else b).references.withColumn("pipeline", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def main_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of v1 without the bibliography."""
    return _result(spark, sf, "v1").main_pages.select("source", "page_number", F.md5("content").alias("digest"))


QUERIES = {f.__name__: f for f in (chunk_v1, chunk_v2_basic, chunk_v2_block, pipeline_references, main_pages)}

# Cutting the bibliography leaves the text as it was before one was added, so the SQL never adds it.
_LAST = "px AS (SELECT page_id, source, page_number, CASE WHEN page_number = max(page_number) OVER (PARTITION BY source) THEN content || chr(10) || chr(10) || 'End of text.' ELSE content END AS content FROM pg WHERE source IS NOT NULL)"
_PLAIN_PAGES = PAGES + "," + _LAST + "," + s_nfkc("px", "page_id", "nf") + f", mp AS (SELECT px.source, px.page_number, {s_clean('nf.content')} AS content FROM nf JOIN px USING (page_id)), mn AS (SELECT * FROM mp WHERE content <> '')"
_BLOCK_PAGES = BLOCKS.replace("bl AS", "b0 AS") + "," + s_nfkc("b0", "block_id", "nf") + f", bl AS (SELECT b0.* REPLACE ({s_clean('nf.content')} AS content) FROM nf JOIN b0 USING (block_id) WHERE {s_clean('nf.content')} <> ''), " + SIGS + ", " + MARGIN_KEPT + ", mn AS (SELECT source, page_number, string_agg(content, chr(10) || chr(10) ORDER BY pos, content) AS content FROM k GROUP BY source, page_number)"
_LINES = f"array_to_string(list_filter(list_transform(string_split(nf.content, chr(10)), lambda x: {s_strip("regexp_replace(x, '[ \\t]+', ' ', 'g')")}), lambda x: x <> ''), chr(10))"
_BLOCK_LINES = BLOCKS.replace("bl AS", "b0 AS") + "," + s_nfkc("b0", "block_id", "nf") + f", b1 AS (SELECT b0.* REPLACE ({_LINES} AS content) FROM nf JOIN b0 USING (block_id) WHERE {_LINES} <> ''), " + SIGS.replace("FROM bl", "FROM b1") + ", " + MARGIN_KEPT.replace("FROM bl", "FROM b1").replace("NOT coalesce(regexp_matches", "coalesce(true OR regexp_matches")
_SIZE = "len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\t-\\r\\x{{1c}}-\\x{{20}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]'))"
_TOKENS = _SIZE[4:-1].replace("|[^", f"{WS.replace('{', '{{').replace('}', '}}')}*|[^").replace("]')", f"]{WS.replace('{', '{{').replace('}', '}}')}*')")


def _size(x: str) -> str:
    return _SIZE.format(x=x)


def _windows(x: str) -> str:
    t = _TOKENS.format(x=x)
    return f"list_filter(list_transform(range(0, len({t}), 320), lambda a: {s_strip(f"array_to_string({t}[a + 1 : a + 320], '')")}), lambda w: w <> '')"


def _sentences(x: str, strict: bool) -> str:
    cut = f"regexp_replace({x}, '([.!?]){WS}+([A-Z0-9])', '\\1' || chr(2) || '\\2', 'g')" if strict else f"regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(2), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(2)), lambda s: {s_strip('s')}), lambda s: s <> '')"


def _fold(key: str, check_first: bool) -> str:
    """CTEs from un (source, n, text, page, key, title, size) to ou (source, c, l: unit numbers of chunk c)."""
    fresh = "false" if check_first else "len(p.held) = 0"
    return f"""
pk AS (SELECT source, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS held, CAST(0 AS BIGINT) AS size, CAST(NULL AS BIGINT[]) AS e1, CAST(NULL AS BIGINT[]) AS e2, CAST(NULL AS VARCHAR) AS lk, CAST(0 AS BIGINT) AS ls FROM (SELECT DISTINCT source FROM un)
 UNION ALL SELECT source, n, CASE WHEN hit THEN CASE WHEN us <= 40 THEN [n] ELSE CAST([] AS BIGINT[]) END ELSE h2 END, CASE WHEN hit THEN CASE WHEN us <= 40 THEN us ELSE 0 END ELSE s2 END, e1, CASE WHEN hit THEN h2 END, uk, us
 FROM (SELECT *, s2 >= 220 AND NOT fresh AS hit FROM (SELECT source, n, uk, us, fresh, CASE WHEN flush THEN held END AS e1, list_append(CASE WHEN flush THEN carry ELSE held END, n) AS h2, us + CASE WHEN flush THEN CASE WHEN len(carry) > 0 THEN ls ELSE 0 END ELSE size END AS s2
  FROM (SELECT *, CASE WHEN NOT sec AND ls <= 40 AND ls + us <= 320 THEN held[len(held):] ELSE CAST([] AS BIGINT[]) END AS carry FROM (SELECT p.source, u.n, p.held, p.size, p.ls, u.key AS uk, u.size AS us, {fresh} AS fresh, p.lk IS DISTINCT FROM u.key AS sec, len(p.held) > 0 AND (p.lk IS DISTINCT FROM u.key OR p.size + u.size > 320) AS flush
   FROM pk p JOIN un u ON u.source = p.source AND u.n = p.n + 1))))),
nn AS (SELECT source, max(n) AS m FROM un GROUP BY source),
em AS (SELECT source, n, 1 AS w, e1 AS l FROM pk WHERE e1 IS NOT NULL UNION ALL SELECT source, n, 2, e2 FROM pk WHERE e2 IS NOT NULL UNION ALL SELECT pk.source, n, 3, held FROM pk JOIN nn ON nn.source = pk.source AND nn.m = pk.n WHERE len(held) > 0),
ec AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n, w) AS c FROM em),
es AS (SELECT ec.source, ec.c, any_value(l) AS l, sum(un.size) AS size, arg_min(un.key, un.n) AS key FROM (SELECT *, unnest(l) AS i FROM ec) ec JOIN un ON un.source = ec.source AND un.n = ec.i GROUP BY ec.source, ec.c),
mg AS (SELECT source, c, l, size, key, CAST(NULL AS BIGINT[]) AS done FROM es WHERE c = 1
 UNION ALL SELECT source, c, CASE WHEN glue THEN list_concat(l, ll) ELSE ll END, CASE WHEN glue THEN size + ss ELSE ss END, CASE WHEN glue THEN key ELSE kk END, CASE WHEN NOT glue THEN l END
 FROM (SELECT m.source, e.c, m.l, m.size, m.key, e.l AS ll, e.size AS ss, e.key AS kk, e.size < 100 AND m.key IS NOT DISTINCT FROM e.key AND m.size + e.size <= 320 AS glue FROM mg m JOIN es e ON e.source = m.source AND e.c = m.c + 1)),
lc AS (SELECT source, max(c) AS m FROM es GROUP BY source),
fi AS (SELECT source, c, done AS l FROM mg WHERE done IS NOT NULL UNION ALL SELECT mg.source, c + 1, l FROM mg JOIN lc ON lc.source = mg.source AND lc.m = mg.c),
ou AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY c) - 1 AS c, l FROM fi)"""


_OUT = f"""ux AS (SELECT source, c, unnest(l) AS i, generate_subscripts(l, 1) AS o FROM ou),
ch AS (SELECT ux.source, c, min(page) AS page_number, max(page) AS page_end, string_agg(text, ' ' ORDER BY o) AS content, arg_min(title, o) AS section_title, arg_min(path, o) AS path FROM ux JOIN un ON un.source = ux.source AND un.n = ux.i GROUP BY ux.source, c)
SELECT source, page_number, page_end, CAST(c AS INTEGER) AS chunk_index, CAST({_size('content')} AS INTEGER) AS token_count, section_title, content, @parent AS parent_id, md5(CASE WHEN path <> '' THEN 'Section: ' || path || chr(10) || chr(10) || content ELSE content END) AS embedded FROM ch"""
_PATHS = """lv AS (SELECT *, regexp_extract(h, '^(\\d+(?:\\.\\d+)*)', 1) AS num FROM hd),
wp AS (SELECT source, k, [h] AS path FROM lv WHERE k = 1 UNION ALL SELECT lv.source, lv.k, CASE WHEN num = '' THEN [h] ELSE list_append(wp.path[1 : len(string_split(num, '.')) - 1], h) END FROM wp JOIN lv ON lv.source = wp.source AND lv.k = wp.k + 1)"""
_W = "list_filter(string_split_regex(x, '" + WS + "+'), lambda w: w <> '')"
_NUMBERED = f"'^(\\d+(?:\\.\\d+){{0,3}})[.)]?{WS}+(.+)$'"
_KNOWN = "'(?i)^(?:Abstract|Introduction|Background|Methods?|Methodology|Results?|Discussion|Conclusion|Conclusions|Future Work|Future Directions|Limitations)$'"
ORACLES = {
    "main_pages": "WITH " + _PLAIN_PAGES + " SELECT source, page_number, md5(content) AS digest FROM mn",
    "pipeline_references": "WITH s AS (SELECT DISTINCT source FROM doc_pages WHERE page_id IS NOT NULL AND source IS NOT NULL), t AS (SELECT DISTINCT source FROM blocks WHERE block_id IS NOT NULL AND source IS NOT NULL), a AS (SELECT 'v1' AS pipeline, source FROM s UNION ALL SELECT 'v2-basic', source FROM s UNION ALL SELECT 'v2-block', source FROM t) SELECT pipeline, source, n AS number, c AS content FROM a, (VALUES (1, 'A first entry, 2001.'), (2, 'A second one, pp. 3-4.')) v(n, c)",
    "chunk_v1": "WITH RECURSIVE " + _PLAIN_PAGES + f""",
pp AS (SELECT source, page_number, ps, u.i AS i, ps[u.i] AS x FROM (SELECT source, page_number, {s_paragraphs('content')} AS ps FROM mn) q, unnest(range(1, len(ps) + 1)) AS u(i)),
se AS (SELECT source, page_number, i, 0 AS j, {_W} AS w FROM pp WHERE len({_W}) <= 500 UNION ALL SELECT source, page_number, i, j, {_W} FROM (SELECT source, page_number, i, unnest({_sentences('x', False)}) AS x, generate_subscripts({_sentences('x', False)}, 1) AS j FROM pp WHERE len({_W}) > 500)),
wi AS (SELECT source, page_number, i, j, a, w[a + 1 : a + 500] AS w FROM (SELECT *, unnest(range(0, len(w), 500)) AS a FROM se)),
un AS (SELECT *, row_number() OVER (PARTITION BY source, page_number ORDER BY i, j, a) AS n FROM wi),
pk AS (SELECT source, page_number, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS VARCHAR[]) AS e1, CAST(NULL AS VARCHAR[]) AS e2 FROM (SELECT DISTINCT source, page_number FROM un)
 UNION ALL SELECT source, page_number, n, CASE WHEN len(h) > 500 THEN h[426:] ELSE h END, e1, CASE WHEN len(h) > 500 THEN h[1:500] END FROM (SELECT p.source, p.page_number, u.n, CASE WHEN len(held) > 0 AND len(held) + len(w) > 500 THEN held END AS e1, list_concat(CASE WHEN len(held) + len(w) > 500 THEN held[greatest(1, len(held) - 74):] ELSE held END, w) AS h FROM pk p JOIN un u ON u.source = p.source AND u.page_number = p.page_number AND u.n = p.n + 1)),
nn AS (SELECT source, page_number, max(n) AS m FROM un GROUP BY 1, 2),
em AS (SELECT source, page_number, n, 1 AS k, e1 AS l FROM pk WHERE e1 IS NOT NULL UNION ALL SELECT source, page_number, n, 2, e2 FROM pk WHERE e2 IS NOT NULL UNION ALL SELECT pk.source, pk.page_number, n, 3, held FROM pk JOIN nn ON nn.source = pk.source AND nn.page_number = pk.page_number AND m = n WHERE len(held) > 0)
SELECT source, page_number, page_number AS page_end, CAST(row_number() OVER (PARTITION BY source ORDER BY page_number, n, k) - 1 AS INTEGER) AS chunk_index, CAST(len(l) AS INTEGER) AS token_count, CAST(NULL AS VARCHAR) AS section_title, array_to_string(l, ' ') AS content, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS embedded FROM em""",
    "chunk_v2_basic": "WITH RECURSIVE " + _BLOCK_PAGES + f""",
pr AS (SELECT source, page_number, u.i AS i, ps[u.i] AS x FROM (SELECT source, page_number, list_filter(list_transform(string_split_regex(content, '\\n{WS}*\\n'), lambda x: {s_strip('x')}), lambda x: x <> '') AS ps FROM mn) q, unnest(range(1, len(ps) + 1)) AS u(i)),
ph AS (SELECT *, CASE WHEN len({_W}) > 18 THEN NULL WHEN regexp_matches(x, {_NUMBERED}) THEN regexp_extract(x, {_NUMBERED}, 1) || ' ' || {s_strip(f"regexp_extract(x, {_NUMBERED}, 2)")} WHEN regexp_matches(x, {_KNOWN}) THEN x END AS h FROM pr),
hd AS (SELECT source, h, row_number() OVER (PARTITION BY source ORDER BY page_number, i) AS k FROM ph WHERE h IS NOT NULL), """ + _PATHS + f""",
pt AS (SELECT *, count(h) OVER (PARTITION BY source ORDER BY page_number, i ROWS UNBOUNDED PRECEDING) AS k, last_value(h IGNORE NULLS) OVER (PARTITION BY source ORDER BY page_number, i ROWS UNBOUNDED PRECEDING) AS title FROM ph),
py AS (SELECT pt.source, page_number, i, x, title, coalesce(array_to_string(path, ' > '), '') AS path FROM pt LEFT JOIN wp ON wp.source = pt.source AND wp.k = pt.k WHERE h IS NULL),
s1 AS (SELECT *, 0 AS j FROM py WHERE {_size('x')} <= 320 UNION ALL SELECT source, page_number, i, unnest({_sentences('x', False)}), title, path, generate_subscripts({_sentences('x', False)}, 1) FROM py WHERE {_size('x')} > 320),
s2 AS (SELECT source, page_number, i, j, 0 AS a, x, title, path FROM s1 WHERE {_size('x')} <= 320 UNION ALL SELECT source, page_number, i, j, generate_subscripts({_windows('x')}, 1), unnest({_windows('x')}), title, path FROM s1 WHERE {_size('x')} > 320),
un AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY page_number, i, j, a) AS n, x AS text, page_number AS page, title AS key, title, path, {_size('x')} AS size FROM s2),""" + _fold("title", False) + "," + _OUT.replace("@parent", "CAST(NULL AS VARCHAR)"),
    "chunk_v2_block": "WITH RECURSIVE " + _BLOCK_LINES + ", cb AS (" + cleaned("k") + f"), {INLINE_PIECES}, bl AS (SELECT k.* REPLACE (ip.pos AS pos, ip.content AS content) FROM ip JOIN k USING (block_id)), " + BODY + f""",
hd AS (SELECT source, page_number, pos, {HEAD} AS h, row_number() OVER (PARTITION BY source ORDER BY page_number, pos) AS k FROM ty WHERE kind = 'heading'), """ + _PATHS + f""",
bk AS (SELECT *, count(*) FILTER (WHERE kind = 'heading') OVER (PARTITION BY source ORDER BY page_number, pos ROWS UNBOUNDED PRECEDING) AS k FROM ty),
py AS (SELECT bk.source, page_number, pos, content AS x, coalesce(array_to_string(path, ' > '), '') AS path, path[len(path)] AS title FROM bk LEFT JOIN wp ON wp.source = bk.source AND wp.k = bk.k WHERE kind = 'prose'),
s1 AS (SELECT source, page_number, pos, unnest({_sentences('x', True)}) AS x, title, path, generate_subscripts({_sentences('x', True)}, 1) AS j FROM py),
s2 AS (SELECT source, page_number, pos, j, 0 AS a, x, title, path FROM s1 WHERE {_size('x')} <= 320 UNION ALL SELECT source, page_number, pos, j, generate_subscripts({_windows('x')}, 1), unnest({_windows('x')}), title, path FROM s1 WHERE {_size('x')} > 320),
un AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY page_number, pos, j, a) AS n, x AS text, page_number AS page, path AS key, title, path, {_size('x')} AS size FROM s2),""" + _fold("path", True) + "," + _OUT.replace("@parent", "CASE WHEN path <> '' THEN 'P-' || left(sha1(source || '::' || path), 12) END"),
}
