"""Queries on citations, evidence, rendering and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import jaccard
from marginalia.operators import alignment, citations
from marginalia.operators.orphans import source_key
from marginalia.plans.common import CHUNKS, EVIDENCE, REFS, WS, chunks, evidence, refs, s_key, s_squeeze, s_strip, s_tokens, s_words
from marginalia.session import staged


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return refs(spark, sf).groupBy("source").agg(F.array_sort(F.collect_set("number")).alias("known"))


def _cited_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf).where("source IS NOT NULL").withColumn("source", source_key(F.col("source")))
    return c.join(_known(spark, sf), "source", "left").withColumn("known", F.coalesce("known", F.array().cast("array<int>")))


def expand_citations(spark: SparkSession, sf: str) -> DataFrame:
    c = _cited_chunks(spark, sf).select("chunk_id", "known", F.posexplode(F.regexp_extract_all("content", F.lit(citations.NUMERIC), F.lit(1))).alias("g", "text"))
    return c.select("chunk_id", "g", F.posexplode(citations.expand_numbers(F.col("text"), F.col("known"))).alias("pos", "number"))


def normalize_citations(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.col("source"), F.lit(".pdf"))
    c = _cited_chunks(spark, sf).withColumn("text", citations.before_marks(citations.normalize(F.col("content"), name, F.col("known"))))
    return c.select("chunk_id", "text", F.size(citations.cited(F.col("text"))).alias("n_cited"))


def _evidence_of_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's chunks as the ranked results of one query."""
    c = chunks(spark, sf).where("source IS NOT NULL AND content IS NOT NULL").withColumn("source", F.concat(source_key(F.col("source")), F.lit(".pdf")))
    r = refs(spark, sf).select(F.concat("source", F.lit(".pdf")).alias("source"), "number")
    c = c.withColumn("query_id", F.concat_ws(":", "source", "page_number")).withColumn("rank", F.col("chunk_index"))
    return citations.build_evidence(c.select("query_id", "rank", "source", "page_number", "content"), r)


def build_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence_of_chunks(spark, sf)


def _rendered(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for each query id that cites its evidence in several ways, one of them unknown."""
    e = staged(evidence(spark, sf, "reference_numbers", "id").where("query_id IS NOT NULL AND source IS NOT NULL AND page_number IS NOT NULL"))
    answers = e.select("query_id").distinct().withColumn("answer", F.lit("First [E1]. Both [E1, E2] hold [E1; E2] [E2]. Unknown [E1, E99999]."))
    return citations.render(answers, e.withColumn("source", F.concat(source_key(F.col("source")), F.lit(".pdf"))))


def render_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf).select("query_id", "rendered")


def extract_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf).select("query_id", F.posexplode(citations.cited(F.col("rendered"))).alias("pos", "c")).select("query_id", "pos", "c.source", "c.number")


def final_bibliography(spark: SparkSession, sf: str) -> DataFrame:
    r = refs(spark, sf).withColumn("source", F.concat("source", F.lit(".pdf")))
    return citations.final_bibliography(_rendered(spark, sf), r)


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    e = evidence(spark, sf, "id").where("query_id IS NOT NULL AND content IS NOT NULL")
    q = e.select("query_id").distinct().withColumn("text", F.concat(F.lit("What is known of topic "), "query_id", F.lit("?")))
    return citations.prompts(q, e.select("query_id", "id", "content"))


def _aligned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = alignment.usable_evidence(evidence(spark, sf, "reference_numbers")).withColumn("source", source_key(F.col("source")))
    r = refs(spark, sf).where("content IS NOT NULL")
    return e, r, alignment.align_pairs(e, r)


def align_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf)[2]


def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e, r, _ = _aligned(spark, sf)
    x = e.select("ev_id", "source", "content", F.explode(F.array_distinct(F.array_compact("reference_numbers"))).alias("number"))
    return x.join(r.withColumnRenamed("content", "ref"), ["source", "number"]).select("ev_id", "number", F.round(jaccard(F.col("content"), F.col("ref")), 6).alias("jaccard"))


def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    e, r, _ = _aligned(spark, sf)
    return alignment.hard_negatives(e, r)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    e, r, cited = _aligned(spark, sf)
    n = alignment.hard_negatives(e, r).join(e.select("ev_id", "content"), "ev_id").join(r.withColumnRenamed("content", "ref"), ["source", "number"])
    n = n.select(F.lit("negative").alias("type"), "ev_id", "source", "number", alignment.lexical_alignment(F.col("content"), F.col("ref")).alias("score"))
    return staged(cited.select(F.lit("cited").alias("type"), "ev_id", "source", "number", "score").unionByName(n))


def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.score_summary(_scores(spark, sf))


def threshold_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.threshold_diagnostics(_scores(spark, sf), alignment.SHARE_THRESHOLDS)


def score_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.extremes(_scores(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        expand_citations, normalize_citations, build_evidence, render_citations, extract_citations, final_bibliography, prompts, align_pairs, jaccard_pairs, hard_negatives, score_summary, threshold_diagnostics, score_extremes,
    )
}

_KEYED = f"ck AS (SELECT chunk_id, content, {s_key('source')} AS source FROM ch WHERE source IS NOT NULL)"
_USABLE = f"""ue AS (SELECT ev_id, {s_key('source')} AS source, page_number, content, reference_numbers FROM (SELECT *, row_number() OVER (PARTITION BY source, page_number, regexp_replace(content, '[\\s]+', ' ', 'g'), CAST(reference_numbers AS VARCHAR) ORDER BY ev_id) AS n FROM ev WHERE content <> '' AND source <> '' AND page_number IS NOT NULL AND len(reference_numbers) > 0) WHERE n = 1),
cx AS (SELECT ev_id, source, content, u.i AS i, reference_numbers[u.i] AS number, reference_numbers FROM ue, unnest(range(1, len(reference_numbers) + 1)) AS u(i) WHERE reference_numbers[u.i] IS NOT NULL),
cy AS (SELECT ev_id, any_value(source) AS source, any_value(content) AS content, number, min(i) AS i FROM cx GROUP BY ev_id, number), cz AS (SELECT *, row_number() OVER (PARTITION BY ev_id ORDER BY i) - 1 AS pos FROM cy), rr AS (SELECT * FROM rf WHERE content IS NOT NULL)"""


def share_of_tokens(a: str, b: str) -> str:
    x, y = f"list_distinct({s_tokens(a)})", f"list_distinct({s_tokens(b)})"
    return f"round(coalesce(len(list_intersect({x}, {y})) * 1.0 / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0), 6)"


_PAIRS = f"al AS (SELECT ev_id, pos, cz.source, cz.number, {share_of_tokens('cz.content', 'rr.content')} AS score FROM cz JOIN rr ON rr.source = cz.source AND rr.number = cz.number)"
_NEG = """an AS (SELECT ev_id, source, content, first(number ORDER BY pos) AS anchor, list(number) AS cited FROM (SELECT * FROM cz) GROUP BY ev_id, source, content),
ng AS (SELECT ev_id, an.source, rr.number, an.content, rr.content AS ref, row_number() OVER (PARTITION BY ev_id ORDER BY abs(rr.number - anchor), rr.number) AS rank FROM an JOIN rr ON rr.source = an.source WHERE NOT list_contains(cited, rr.number))"""
_SCORES = f"s AS (SELECT 'cited' AS type, ev_id, source, number, score FROM al UNION ALL SELECT 'negative', ev_id, source, number, {share_of_tokens('content', 'ref')} FROM ng WHERE rank <= 2)"
_ALL = "WITH " + EVIDENCE + "," + REFS + "," + _USABLE + "," + _PAIRS + "," + _NEG + "," + _SCORES
_ONE = rf"\[[^\]]+?\.pdf,{WS}*ref{WS}+\d+\]"
_DONE = rf"\[[^\[\]]+?\.pdf,{WS}*(?:ref{WS}+\d+|page{WS}+\d+)\]"
_BEFORE = rf"""regexp_replace(@, '(?i)([.!?]){WS}+((?:{_ONE}{WS}*)*{_ONE}){WS}*([A-Z0-9])', ' \2\1 \3', 'g')"""


def _normalized(source: str) -> str:
    """CTE nm (chunk_id, text) from ck0 (chunk_id, content, key: of the source, source: its name)."""
    return rf"""kn AS (SELECT DISTINCT source AS key FROM rf),
g0 AS (SELECT chunk_id, key, source, string_split_regex(content, '\[[0-9,\-\s]+\]') AS gaps, regexp_extract_all(content, '\[[0-9,\-\s]+\]') AS found FROM {source} WHERE content IS NOT NULL),
g1 AS (SELECT chunk_id, key, source, u.i AS g, found[u.i] AS m, string_split(regexp_extract(found[u.i], '\[([0-9,\-\s]+)\]', 1), ',') AS parts FROM g0, unnest(range(1, len(found) + 1)) AS u(i)),
g2 AS (SELECT chunk_id, key, source, g, u.i AS pi, {s_strip('parts[u.i]')} AS t FROM g1, unnest(range(1, len(parts) + 1)) AS u(i)),
g3 AS (SELECT g2.chunk_id, g2.g, string_agg('[' || g2.source || ', ref ' || rf.number || ']', ' ' ORDER BY pi, rf.number) AS new FROM g2 JOIN rf ON rf.source = g2.key WHERE CASE WHEN regexp_matches(t, '^\d+\s*-\s*\d+$') THEN rf.number BETWEEN CAST(regexp_extract(t, '^(\d+)', 1) AS HUGEINT) AND CAST(regexp_extract(t, '(\d+)$', 1) AS HUGEINT) WHEN regexp_matches(t, '^\d{{1,9}}$') THEN rf.number = CAST(t AS BIGINT) ELSE false END GROUP BY 1, 2),
g4 AS (SELECT chunk_id, list(coalesce(new, m) ORDER BY g) AS news FROM g1 LEFT JOIN g3 USING (chunk_id, g) GROUP BY chunk_id),
g5 AS (SELECT chunk_id, source, array_to_string(flatten(list_transform(gaps, lambda x, i: CASE WHEN i <= len(found) THEN [x, news[i]] ELSE [x] END)), '') AS text FROM g0 LEFT JOIN g4 USING (chunk_id)),
nm AS (SELECT chunk_id, {_BEFORE.replace('@', 'text')} AS text FROM g5)"""


_CITES = rf"""list_zip(regexp_extract_all(@, '(?i)\[([^\]]+?\.pdf),{WS}*ref{WS}+(\d+)\]', 1), regexp_extract_all(@, '(?i)\[([^\]]+?\.pdf),{WS}*ref{WS}+(\d+)\]', 2))"""
_ANSWER = "'First [E1]. Both [E1, E2] hold [E1; E2] [E2]. Unknown [E1, E99999].'"
# The answer's groups, filled in from the two evidence rows of a query; a missing second one leaves its groups as they are.
_RENDER = EVIDENCE.replace("query_id, source", "query_id, id, source") + "," + REFS + rf""",
e0 AS (SELECT query_id, id, CASE WHEN len(reference_numbers) > 0 THEN list_transform(reference_numbers, lambda n: '[' || {s_key('source')} || '.pdf, ref ' || n || ']') ELSE ['[' || {s_key('source')} || '.pdf, page ' || page_number || ']'] END AS cites FROM ev WHERE query_id IS NOT NULL AND source IS NOT NULL AND page_number IS NOT NULL),
qa AS (SELECT query_id, any_value(cites) FILTER (WHERE id = 'E1') AS c1, any_value(cites) FILTER (WHERE id = 'E2') AS c2, bool_or(id = 'E99999') AS c9 FROM e0 GROUP BY query_id),
ga AS (SELECT query_id, u.g, CASE WHEN u.g = 5 AND c9 THEN NULL WHEN u.g = 5 THEN '[E1, E99999]' WHEN (u.a AND c1 IS NULL) OR (u.b AND c2 IS NULL) THEN u.txt ELSE NULL END AS kept, list_concat(CASE WHEN u.a THEN c1 ELSE [] END, CASE WHEN u.b THEN c2 ELSE [] END) AS l FROM qa, (VALUES (1, '[E1]', true, false), (2, '[E1, E2]', true, true), (3, '[E1; E2]', true, true), (4, '[E2]', false, true), (5, '[E1, E99999]', false, false)) u(g, txt, a, b)),
gd AS (SELECT query_id, g, CASE WHEN kept IS NOT NULL THEN kept ELSE array_to_string(list_filter(l, lambda x, i: x IS NOT NULL AND list_position(l, x) = i), ' ') END AS t FROM ga),
an AS (SELECT query_id, 'First ' || max(t) FILTER (WHERE g = 1) || '. Both ' || max(t) FILTER (WHERE g = 2) || ' hold ' || max(t) FILTER (WHERE g = 3) || ' ' || max(t) FILTER (WHERE g = 4) || '. Unknown ' || max(t) FILTER (WHERE g = 5) || '.' AS a FROM gd GROUP BY query_id),
rs AS (SELECT query_id, string_split_regex(a, '(?i){_DONE}(?:{WS}+{_DONE})+') AS gaps, regexp_extract_all(a, '(?i){_DONE}(?:{WS}+{_DONE})+') AS runs FROM an),
rl AS (SELECT query_id, gaps, list_transform(runs, lambda r: regexp_extract_all(r, '(?i){_DONE}')) AS runs FROM rs),
rn AS (SELECT query_id, array_to_string(flatten(list_transform(gaps, lambda x, i: CASE WHEN i <= len(runs) THEN [x, array_to_string(list_filter(runs[i], lambda c, k: list_position(list_transform(runs[i], lambda z: lower(z)), lower(c)) = k), ' ')] ELSE [x] END)), '') AS rendered FROM rl),
ci AS (SELECT query_id, {_CITES.replace('@', 'rendered')} AS l FROM rn),
cu AS (SELECT query_id, u.i AS i, l[u.i] AS c FROM ci, unnest(range(1, len(l) + 1)) AS u(i)),
cp AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS pos, trim(c[1]) AS source, CAST(c[2] AS INTEGER) AS number FROM (SELECT query_id, c, min(i) AS i FROM cu GROUP BY query_id, c))"""
ORACLES = {
    "normalize_citations": "WITH " + CHUNKS + "," + REFS + f", ck0 AS (SELECT chunk_id, content, {s_key('source')} AS key, {s_key('source')} || '.pdf' AS source FROM ch WHERE source IS NOT NULL), " + _normalized("ck0") + f" SELECT ck0.chunk_id, text, CAST(CASE WHEN text IS NULL THEN NULL ELSE len(list_distinct({_CITES.replace('@', 'text')})) END AS INTEGER) AS n_cited FROM ck0 LEFT JOIN nm USING (chunk_id)",
    "build_evidence": "WITH " + CHUNKS + "," + REFS + f", ck0 AS (SELECT chunk_id, content, {s_key('source')} AS key, {s_key('source')} || '.pdf' AS source, page_number, chunk_index FROM ch WHERE source IS NOT NULL AND content IS NOT NULL), " + _normalized("ck0") + rf""",
st AS (SELECT chunk_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){WS}+([A-Z0-9])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda x: {s_strip('x')}), lambda x: x <> '') AS l FROM nm),
su AS (SELECT chunk_id, u.i AS i, l[u.i] AS s FROM st, unnest(range(1, len(l) + 1)) AS u(i)),
sv AS (SELECT ck0.source, page_number, chunk_index, chunk_id, i, {s_squeeze(f"regexp_replace(s, '(?i){_ONE}', '', 'g')")} AS content, list_transform(list_filter({_CITES.replace('@', 's')}, lambda c: {s_strip('c[1]')} = ck0.source), lambda c: CAST(c[2] AS INTEGER)) AS l FROM su JOIN ck0 USING (chunk_id))
SELECT source || coalesce(':' || page_number, '') AS query_id, 'E' || row_number() OVER (PARTITION BY source, page_number ORDER BY chunk_index, i) AS id, content, source, page_number, list_filter(l, lambda x, k: list_position(l, x) = k) AS reference_numbers FROM sv WHERE content <> ''""",
    "render_citations": "WITH " + _RENDER + " SELECT query_id, rendered FROM rn",
    "extract_citations": "WITH " + _RENDER + " SELECT query_id, CAST(pos AS INTEGER) AS pos, source, number FROM cp",
    "final_bibliography": "WITH " + _RENDER + " SELECT query_id, CAST(pos AS INTEGER) AS pos, cp.source, cp.number, rf.content FROM cp JOIN rf ON rf.source || '.pdf' = cp.source AND rf.number = cp.number",
    "prompts": f"WITH e AS (SELECT DISTINCT ev_id, query_id, id, content FROM evidence WHERE ev_id IS NOT NULL AND query_id IS NOT NULL AND content IS NOT NULL), g AS (SELECT query_id, string_agg(id || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY CAST(substr(id, 2) AS INTEGER), id || chr(10) || content) AS l FROM e GROUP BY query_id) SELECT query_id, '{citations.RULES.replace(chr(39), chr(39) * 2)}' || chr(10) || chr(10) || 'Question: What is known of topic ' || query_id || '?' || chr(10) || chr(10) || 'Evidence:' || chr(10) || l AS prompt FROM g",
    "expand_citations": "WITH " + CHUNKS + "," + REFS + "," + _KEYED + r""", g AS (SELECT chunk_id, source, regexp_extract_all(content, '\[([0-9,\-\s]+)\]', 1) AS l FROM ck WHERE content IS NOT NULL),
h AS (SELECT chunk_id, source, u.i - 1 AS g, string_split(l[u.i], ',') AS parts FROM g, unnest(range(1, len(l) + 1)) AS u(i)),
p AS (SELECT chunk_id, source, g, u.i AS pi, trim(replace(parts[u.i], chr(10), ' ')) AS t FROM h, unnest(range(1, len(parts) + 1)) AS u(i)),
e AS (SELECT chunk_id, g, pi, rf.number FROM p JOIN rf ON rf.source = p.source WHERE CASE WHEN regexp_matches(t, '^\d+\s*-\s*\d+$') THEN rf.number BETWEEN CAST(regexp_extract(t, '^(\d+)', 1) AS HUGEINT) AND CAST(regexp_extract(t, '(\d+)$', 1) AS HUGEINT) WHEN regexp_matches(t, '^\d{1,9}$') THEN rf.number = CAST(t AS BIGINT) ELSE false END)
SELECT chunk_id, CAST(g AS INTEGER) AS g, CAST(row_number() OVER (PARTITION BY chunk_id, g ORDER BY pi, number) - 1 AS INTEGER) AS pos, number FROM e""",
    "align_pairs": _ALL + " SELECT ev_id, CAST(pos AS INTEGER) AS pos, source, number, CAST(score AS DOUBLE) AS score FROM al",
    "jaccard_pairs": _ALL + f", w AS (SELECT ev_id, cz.number, list_distinct({s_words('lower(cz.content)')}) AS x, list_distinct({s_words('lower(rr.content)')}) AS y FROM cz JOIN rr ON rr.source = cz.source AND rr.number = cz.number) SELECT ev_id, number, CAST(round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))) ELSE 0 END, 6) AS DOUBLE) AS jaccard FROM w",
    "hard_negatives": _ALL + " SELECT ev_id, source, number, CAST(rank AS INTEGER) AS rank FROM ng WHERE rank <= 2",
    "score_summary": _ALL + " SELECT type, count(*) AS n, CAST(min(score) AS DOUBLE) AS min, " + ", ".join(f"round(quantile_cont(CAST(score AS DOUBLE), {p}), 6) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + ", round(avg(score), 6) AS mean, CAST(max(score) AS DOUBLE) AS max FROM s GROUP BY type",
    "threshold_diagnostics": _ALL + " SELECT CAST(t AS DOUBLE) AS threshold, round(coalesce(avg(CASE WHEN score >= t THEN 1.0 ELSE 0 END) FILTER (WHERE type = 'cited'), 0), 6) AS cited_kept, round(coalesce(avg(CASE WHEN score < t THEN 1.0 ELSE 0 END) FILTER (WHERE type = 'negative'), 0), 6) AS negative_rejected FROM s CROSS JOIN (VALUES (0.0), (0.05), (0.1), (0.15), (0.2), (0.3), (0.4), (0.5)) v(t) GROUP BY t",
    "score_extremes": _ALL + " SELECT type, ev_id, source, number, CAST(score AS DOUBLE) AS score FROM (SELECT * FROM s WHERE type = 'cited' ORDER BY score, ev_id, number LIMIT 15) UNION ALL SELECT type, ev_id, source, number, CAST(score AS DOUBLE) FROM (SELECT * FROM s WHERE type = 'negative' ORDER BY score DESC, ev_id, number LIMIT 15)",
}
