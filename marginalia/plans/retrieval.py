"""Queries on retrieval, fusion, evaluation and chunk stores. The stated queries are the records of
``evidence`` (texts) and ``embeddings`` (vectors) whose id is divisible by 50, against all rows; metrics_pages has all records of ``evidence``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import vectors as V
from marginalia.functions.ids import parent_id, point_id
from marginalia.functions.text import embedding_text, text_to_embed
from marginalia.operators import dense, evaluation, quality, ranking, sparse
from marginalia.operators.orphans import source_key
from marginalia.plans.common import CHUNKS, EVIDENCE, WS, blocks, chunks, evidence, pages, s_key, s_squeeze, s_strip, s_tokens, s_words
from marginalia.plugins import embed_column
from marginalia.session import checkpoint_dir, staged
from marginalia.sources.store import VectorStore
from marginalia.sources.tables import once, read

PROCEEDINGS = "Proceedings_Collected_Volumes.pdf"
K, CANDIDATES = 5, 12


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).withColumnRenamed("chunk_id", "doc")


_KEPT: dict[tuple[str, str, str], object] = {}


def _kept(spark: SparkSession, sf: str, what: str, make):  # noqa: ANN001, ANN202
    """Built by the first query that needs it, and stored for the session."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def _contents(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, "contents", lambda: staged(_corpus(spark, sf)))


def _index(spark: SparkSession, sf: str) -> sparse.Index:
    return _kept(spark, sf, "index", lambda: sparse.build_index(_contents(spark, sf)))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """doc, vector of the contents."""
    return _kept(spark, sf, "vectors", lambda: staged(_contents(spark, sf).where("content <> ''").select("doc", embed_column(F.col("content")).alias("vector"))))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, "asked", lambda: staged(evidence(spark, sf).where("ev_id % 50 = 0 AND content IS NOT NULL").select(F.col("ev_id").alias("query_id"), F.col("content").alias("text"))))


def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.postings(_corpus(spark, sf)).select("doc", "term", "tf", "len")


def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.document_frequency(sparse.postings(_corpus(spark, sf)))


def bm25_idf(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.bm25_topk(_index(spark, sf), _asked(spark, sf), K)


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings", ["vec_id", "embedding"]).select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf)
    return dense.vector_topk(e, e.where("doc % 50 = 0").withColumnRenamed("doc", "query_id"), 10)


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    u = V.l2_normalize(F.col("vector"))
    return _embeddings(spark, sf).select("doc", F.round(V.norm(F.col("vector")), 6).alias("norm"), F.round(V.cosine(F.col("vector"), F.reverse("vector")), 6).alias("mirrored"), F.round(V.norm(u), 6).alias("unit"))


def _ranked(spark: SparkSession, sf: str, k: int = CANDIDATES) -> DataFrame:
    return sparse.bm25_topk(_index(spark, sf), _asked(spark, sf), k).join(_contents(spark, sf).select("doc", "content", "source", "page_number", "chunk_index"), "doc")


def greedy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dense.greedy_dedup(_ranked(spark, sf, 3 * K), K)


def _dense(spark: SparkSession, sf: str, k: int, candidates: int | None = None) -> DataFrame:
    return dense.dense_retrieve(_vectors(spark, sf), _asked(spark, sf).select("query_id", embed_column(F.col("text")).alias("vector")), _contents(spark, sf), k, candidates)


def dense_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """Over-fetch and suppression with the offline stand-in of an embedder."""
    return _dense(spark, sf, K)


def _hybrid(spark: SparkSession, sf: str, found: DataFrame | None = None) -> DataFrame:
    """Dense and sparse candidates, fused and reranked. found: the dense ones, where they are there already."""
    q = _asked(spark, sf)
    fused = ranking.rrf_fuse([found if found is not None else _dense(spark, sf, 8), sparse.bm25_topk(_index(spark, sf), q, 8)], CANDIDATES)
    return ranking.rerank(fused.join(_contents(spark, sf).select("doc", "content"), "doc").join(q, "query_id"), K)


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.shape_results(_hybrid(spark, sf), _contents(spark, sf))


def _reranked(spark: SparkSession, sf: str, pool: DataFrame) -> DataFrame:
    return ranking.rerank(pool.join(_contents(spark, sf).select("doc", "content"), "doc").join(_asked(spark, sf), "query_id"), K)


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    g = evidence(spark, sf).where("ev_id % 50 = 0 AND content IS NOT NULL AND source IS NOT NULL AND page_number IS NOT NULL")
    return staged(g.select(F.col("ev_id").alias("query_id"), source_key(F.col("source")).alias("source"), "page_number"))


def _placed(spark: SparkSession, sf: str, ranked: DataFrame) -> DataFrame:
    c = _contents(spark, sf).select("doc", source_key(F.col("source")).alias("source"), "page_number")
    return ranked.join(c, "doc").select("query_id", "rank", "source", "page_number")


def _compare(spark: SparkSession, sf: str, ways: dict[str, DataFrame], metrics) -> DataFrame:  # noqa: ANN001
    gold, out = _gold(spark, sf), None
    for name, ranked in ways.items():
        one = evaluation.macro(metrics(_placed(spark, sf, ranked), gold)).withColumn("way", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def dense_against_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the single-source metrics of dense results and of the same candidates reranked."""
    pool = staged(_dense(spark, sf, CANDIDATES))
    return _compare(spark, sf, {"dense": pool.where(F.col("rank") <= K), "reranked": _reranked(spark, sf, pool)}, evaluation.by_single_source)


def hybrid_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the metrics by (source, page): dense, dense reranked, and hybrid with reranking."""
    pool = staged(_dense(spark, sf, 8))
    ways = {"dense": pool.where(F.col("rank") <= K), "dense_rerank": _reranked(spark, sf, pool), "hybrid": _hybrid(spark, sf, pool)}
    return _compare(spark, sf, ways, evaluation.by_source_page)


def _lists(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Two ranked lists of references for each query id: those used, and those its evidence cites."""
    key = F.concat_ws(":", source_key(F.col("source")), F.col("number"))
    u = once(read(spark, sf, "used_refs", ["use_id", "query_id", "cite_rank", "source", "number"]), "use_id").where("source IS NOT NULL AND number IS NOT NULL AND query_id IS NOT NULL")
    a = u.select("query_id", key.alias("doc"), F.row_number().over(Window.partitionBy("query_id").orderBy("cite_rank", "use_id")).alias("rank"))
    e = evidence(spark, sf, "reference_numbers").where("source IS NOT NULL AND query_id IS NOT NULL").select("ev_id", "query_id", "source", F.posexplode("reference_numbers").alias("pos", "number")).where("number IS NOT NULL")
    b = e.select("query_id", key.alias("doc"), F.row_number().over(Window.partitionBy("query_id").orderBy("ev_id", "pos")).alias("rank"))
    return [a, b]


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rrf_fuse(_lists(spark, sf), 10)


def rerank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rerank(_ranked(spark, sf).join(_asked(spark, sf), "query_id"), K)


def search_source_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.search(_ranked(spark, sf).join(_asked(spark, sf), "query_id"), 25, f" {PROCEEDINGS.upper()} ", CANDIDATES)


def _judging(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r = _ranked(spark, sf, 6).select("query_id", "rank", source_key(F.col("source")).alias("source"), "page_number")
    return staged(r), _gold(spark, sf)


def metrics_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics by (source, page) of all records of ``evidence`` with a text, a source and a page."""
    e = staged(evidence(spark, sf).where("content IS NOT NULL AND source IS NOT NULL AND page_number IS NOT NULL").select(F.col("ev_id").alias("query_id"), F.col("content").alias("text"), source_key(F.col("source")).alias("source"), "page_number"))
    found = staged(sparse.bm25_topk(_index(spark, sf), e.select("query_id", "text"), 6).select("query_id", "rank", "doc"))
    return evaluation.by_source_page(_placed(spark, sf, found), e.drop("text"))


def metrics_single_source(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.by_single_source(*_judging(spark, sf))


def metrics_page_only(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.by_page_only(*_judging(spark, sf))


def k_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.k_sweep(*_judging(spark, sf), [2, 3, 4, 5, 6])


def candidate_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Page-only metrics before and after reranking, for several numbers of candidates over-fetched and cut to K
    by suppression first."""
    gold, out = _gold(spark, sf), None
    c = _contents(spark, sf)
    found = staged(dense.vector_topk(_vectors(spark, sf), _asked(spark, sf).select("query_id", embed_column(F.col("text")).alias("vector")), 30).join(c.select("doc", "content"), "doc"))
    for n in (4, 8, 12, 16, 20, 30):
        pool = staged(dense.greedy_dedup(found.where(F.col("rank") <= n), K))
        for step, ranked in (("before", pool), ("after", _reranked(spark, sf, pool))):
            one = evaluation.macro(evaluation.by_page_only(_placed(spark, sf, ranked), gold)).withColumns({"candidates": F.lit(n), "step": F.lit(step)})
            out = one if out is None else out.unionByName(one)
    return out


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(chunks(spark, sf, "page_end", "section_title"))


def token_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return quality.token_distribution(chunks(spark, sf))


def block_type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return quality.block_types(blocks(spark, sf, "content_type"))


def smallest_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return quality.smallest_chunks(chunks(spark, sf))


def oversized_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return quality.oversized_chunks(chunks(spark, sf))


def section_names(spark: SparkSession, sf: str) -> DataFrame:
    return quality.section_names(chunks(spark, sf, "section_title"))


def sample_positions(spark: SparkSession, sf: str) -> DataFrame:
    return quality.sample_positions(chunks(spark, sf))


def ingest_counters(spark: SparkSession, sf: str) -> DataFrame:
    r = once(read(spark, sf, "refs", ["ref_id", "source"]), "ref_id")
    return quality.ingest_counters(pages(spark, sf), blocks(spark, sf), r, chunks(spark, sf))


def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("chunk_id", point_id(F.col("source"), F.col("page_number"), F.col("chunk_index")).alias("point_id"))


def parent_ids(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf, "section_path").select("chunk_id", parent_id(F.col("source"), F.col("section_path")).alias("parent"))


def embedding_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf, "section_path", "embedding_text")
    return c.select("chunk_id", F.md5(embedding_text(F.col("content"), F.col("section_path"))).alias("built"), F.md5(text_to_embed(F.col("embedding_text"), F.col("content"))).alias("used"))


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A first half, then all chunks with other contents for a part: the store's state afterwards."""
    import uuid

    store = VectorStore(spark, f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", 2)
    c = chunks(spark, sf).select("chunk_id", "source", "page_number", "chunk_index", "content", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    store.upsert(c.where("chunk_id % 2 = 0"))
    store.upsert(c.where("chunk_id % 3 = 0").withColumn("content", F.lit("changed")))
    return store.scan().groupBy("source").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("content") == "changed").alias("changed"))


QUERIES = {
    f.__name__: f
    for f in (
        term_frequency, document_frequency, bm25_idf, bm25_topk, vector_topk, vector_norms, greedy_dedup, dense_retrieve, hybrid_topk, rrf_fuse, rerank_lexical, search_source_filter, metrics_pages, metrics_single_source, metrics_page_only,
        k_sweep, candidate_sweep, dense_against_rerank, hybrid_evaluation, quality_report, token_distribution, block_type_histogram, smallest_chunks, oversized_chunks, section_names, sample_positions, ingest_counters, point_ids, parent_ids, embedding_texts,
        upsert_merge,
    )
}

_DOCS = f"tk AS (SELECT chunk_id AS doc, source, page_number, chunk_index, content, {s_tokens('content')} AS t FROM ch WHERE content IS NOT NULL AND {s_strip('content')} <> '')"
_POST = "po AS (SELECT doc, term, count(*) AS tf, any_value(n) AS len FROM (SELECT doc, len(t) AS n, unnest(t) AS term FROM tk) GROUP BY doc, term)"
_IDF = """dfr AS (SELECT term, count(*) AS df FROM po GROUP BY term), sz AS (SELECT count(*) AS n, avg(len(t)) AS avglen FROM tk),
rw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfr, sz), idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rw) ELSE raw END AS idf FROM rw)"""
_BASE = "WITH " + CHUNKS + "," + EVIDENCE + "," + _DOCS + "," + _POST + "," + _IDF + f""",
qs AS (SELECT ev_id AS query_id, content AS text FROM ev WHERE ev_id % 50 = 0 AND content IS NOT NULL),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({s_tokens('text')}) AS term FROM qs) GROUP BY 1, 2),
sc AS (SELECT query_id, doc, round(sum(times * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avglen))), 6) AS score FROM qt JOIN idf USING (term) JOIN po USING (term), sz GROUP BY query_id, doc),
al AS (SELECT query_id, doc, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM qt) q CROSS JOIN (SELECT doc FROM tk) LEFT JOIN sc USING (query_id, doc)),
bm AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank, doc, score FROM al),
"""
_LEX = f"round(len(list_intersect(list_distinct({s_tokens('text')}), list_distinct({s_tokens('content')}))) * 1.0 / len(list_distinct({s_tokens('text')})), 6)"
_RR = f"cd AS (SELECT query_id, rank, doc, score, content, source, text FROM bm JOIN tk USING (doc) JOIN qs USING (query_id) WHERE rank <= 12), "
_JUDGE = f"""rk AS (SELECT query_id, rank, {s_key('source')} AS source, page_number FROM bm JOIN tk USING (doc) WHERE rank <= 6),
gd AS (SELECT ev_id AS query_id, {s_key('source')} AS source, page_number FROM ev WHERE ev_id % 50 = 0 AND content IS NOT NULL AND source IS NOT NULL AND page_number IS NOT NULL), """


def _metric(page: str, on: str, shown: str, ranked: str = "rk") -> str:
    return f"""SELECT query_id, CAST(CASE WHEN good > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS hit, CAST(coalesce(good / nullif(shown, 0), 0) AS DOUBLE) AS "precision", CAST(coalesce(good / want, 0) AS DOUBLE) AS recall, CAST(coalesce(1.0 / first, 0) AS DOUBLE) AS reciprocal_rank
FROM (SELECT gd.query_id, count(DISTINCT {page.replace('@', 'gd')}) AS want, any_value(gd.source) AS gs FROM gd GROUP BY gd.query_id) w LEFT JOIN (
 SELECT r.query_id, count(DISTINCT CASE WHEN {shown} THEN {page.replace('@', 'r')} END) AS shown, count(DISTINCT CASE WHEN g.query_id IS NOT NULL THEN {page.replace('@', 'r')} END) AS good, min(CASE WHEN g.query_id IS NOT NULL THEN rank END) AS first
 FROM {ranked} r LEFT JOIN gd g ON g.query_id = r.query_id AND {on} LEFT JOIN (SELECT query_id, any_value(source) AS gs FROM gd GROUP BY 1) o ON o.query_id = r.query_id GROUP BY r.query_id) m USING (query_id)"""


_PAIR = ("(@.source, @.page_number)", "g.source = r.source AND g.page_number = r.page_number", "true")
_SIZE = f"sz0 AS (SELECT *, len({s_tokens("coalesce(content, '')")}) AS size FROM ch)"
_RBASE = _BASE.replace("WITH ", "WITH RECURSIVE ", 1)
_SWEEP = (4, 8, 12, 16, 20, 30)
_MEANS = """count(*) AS queries, round(avg(hit), 6) AS hit, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank"""


def _vector(source: str, key: str, text: str, out: str) -> str:
    """CTE of hashed words: key, d, v (a component, rounded to single precision) and norm."""
    return f"""{out}0 AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT {key}, unnest({s_words(f'lower({text})')}) AS w FROM {source})),
{out}1 AS (SELECT {key}, h % 64 AS d, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS c FROM {out}0 GROUP BY 1, 2),
{out}2 AS (SELECT {key}, d, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS v FROM {out}1 WHERE c <> 0),
{out} AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS norm FROM {out}2)"""


_VECTORS = _vector("(SELECT chunk_id AS doc, content FROM ch WHERE content <> '')", "doc", "content", "vd") + "," + _vector("qs", "query_id", "text", "vq") + """,
vs AS (SELECT query_id, doc, sum(vq.v * vd.v) / any_value(vq.norm) / any_value(vd.norm) AS s FROM vq JOIN vd USING (d) GROUP BY query_id, doc),
dn AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank, doc, score FROM (SELECT query_id, doc, round(coalesce(s, 0), 6) AS score FROM qs CROSS JOIN (SELECT chunk_id AS doc FROM ch WHERE content <> '') LEFT JOIN vs USING (query_id, doc)))"""


def _greedy(ranked: str, k: int, n: int) -> str:
    """CTEs <ranked>_s (the kept docs after each of n candidates) and <ranked>_g (the k results)."""
    return f"""{ranked}_c AS (SELECT query_id, rank, doc, score, list_distinct({s_words('lower(content)')}) AS ws FROM {ranked} JOIN (SELECT chunk_id AS doc, content FROM ch) USING (doc) WHERE rank <= {n} AND content <> ''),
{ranked}_s AS (SELECT query_id, CAST(0 AS BIGINT) AS stp, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT query_id FROM {ranked}_c) UNION ALL
 SELECT g.query_id, g.stp + 1, CASE WHEN len(g.kept) < {k} AND NOT EXISTS (SELECT 1 FROM {ranked}_c o WHERE o.query_id = g.query_id AND list_contains(g.kept, o.doc) AND len(list_intersect(o.ws, c.ws)) >= 0.8 * len(list_distinct(list_concat(o.ws, c.ws)))) THEN list_append(g.kept, c.doc) ELSE g.kept END
 FROM {ranked}_s g JOIN {ranked}_c c ON c.query_id = g.query_id AND c.rank = g.stp + 1),
{ranked}_g AS (SELECT s.query_id, u.i AS rank, s.kept[u.i] AS doc, c.score FROM {ranked}_s s, unnest(range(1, len(kept) + 1)) AS u(i) JOIN {ranked}_c c ON c.query_id = s.query_id AND c.doc = s.kept[u.i] WHERE s.stp = {n})"""


def _rerank_sql(ranked: str) -> str:
    return f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rank, doc, rerank_score FROM (SELECT r.*, {_LEX} AS rerank_score FROM {ranked} r JOIN tk USING (doc) JOIN qs USING (query_id)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) <= 5"


def _placed_sql(ranked: str) -> str:
    return f"SELECT x.query_id, x.rank, {s_key('tk.source')} AS source, tk.page_number FROM {ranked} x JOIN tk USING (doc)"


_HYBRID = _greedy("dn", 8, 24) + f""",
fu AS (SELECT query_id, doc, round(sum(1.0 / (60 + rank)), 9) AS score, min((list, rank)) AS first FROM (SELECT query_id, doc, rank, 0 AS list FROM dn_g UNION ALL SELECT query_id, doc, rank, 1 FROM bm WHERE rank <= 8) GROUP BY query_id, doc),
fr AS (SELECT query_id, doc, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) <= 12),
hy AS (SELECT h.*, fr.score FROM ({_rerank_sql('fr')}) h JOIN fr USING (query_id, doc))"""
ORACLES = {
    "term_frequency": "WITH " + CHUNKS + "," + _DOCS + "," + _POST + " SELECT doc, term, tf, CAST(len AS INTEGER) AS len FROM po",
    "document_frequency": "WITH " + CHUNKS + "," + _DOCS + "," + _POST + " SELECT term, count(*) AS df FROM po GROUP BY term",
    "bm25_idf": "WITH " + CHUNKS + "," + _DOCS + "," + _POST + "," + _IDF + " SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": _BASE + "x AS (SELECT 1) SELECT query_id, CAST(rank AS INTEGER) AS rank, doc, score FROM bm WHERE rank <= 5",
    "vector_topk": "WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS doc, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM p) SELECT query_id, CAST(rank AS INTEGER) AS rank, doc, score FROM r WHERE rank <= 10",
    "vector_norms": "SELECT vec_id AS doc, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS mirrored, CAST(1.0 AS DOUBLE) AS unit FROM embeddings",
    "rrf_fuse": "WITH " + EVIDENCE + f""", us AS (SELECT DISTINCT use_id, query_id, cite_rank, source, number FROM used_refs WHERE use_id IS NOT NULL AND source IS NOT NULL AND number IS NOT NULL AND query_id IS NOT NULL),
a AS (SELECT query_id, {s_key('source')} || ':' || number AS doc, row_number() OVER (PARTITION BY query_id ORDER BY cite_rank, use_id) AS rank, 0 AS list FROM us),
e AS (SELECT ev_id, query_id, source, i AS pos, reference_numbers[i] AS number FROM ev, unnest(range(1, len(reference_numbers) + 1)) AS u(i) WHERE source IS NOT NULL AND query_id IS NOT NULL AND reference_numbers[i] IS NOT NULL),
b AS (SELECT query_id, {s_key('source')} || ':' || number AS doc, row_number() OVER (PARTITION BY query_id ORDER BY ev_id, pos) AS rank, 1 AS list FROM e),
f AS (SELECT query_id, doc, round(sum(1.0 / (60 + rank)), 9) AS score, min((list, rank)) AS first FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query_id, doc),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM f) SELECT query_id, CAST(rank AS INTEGER) AS rank, doc, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= 10""",
    "rerank_lexical": _BASE + _RR + f"n AS (SELECT *, {_LEX} AS rerank_score FROM cd), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new FROM n) SELECT query_id, CAST(new AS INTEGER) AS rank, doc, score, rerank_score FROM o WHERE new <= 5",
    "search_source_filter": _BASE + _RR + f"n AS (SELECT *, {_LEX} AS rerank_score FROM cd WHERE lower(source) = lower('{PROCEEDINGS}')), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new FROM n) SELECT query_id, CAST(new AS INTEGER) AS rank, doc, score, rerank_score FROM o WHERE new <= 20",
    "metrics_pages": (_BASE + _JUDGE).replace("ev_id % 50 = 0 AND ", "") + "x AS (SELECT 1) " + _metric(*_PAIR),
    "metrics_single_source": _BASE + _JUDGE + "x AS (SELECT 1) " + _metric("@.page_number", "g.source = r.source AND g.page_number = r.page_number", "r.source = o.gs"),
    "metrics_page_only": _BASE + _JUDGE + "x AS (SELECT 1) " + _metric("@.page_number", "g.page_number = r.page_number", "true"),
    "k_sweep": _BASE + _JUDGE + ", ".join(f"k{k} AS (SELECT * FROM rk WHERE rank <= {k}), m{k} AS ({_metric(*_PAIR, ranked=f'k{k}')})" for k in range(2, 7)) + " " + " UNION ALL ".join(f"""SELECT CAST({k} AS INTEGER) AS k, count(*) AS queries, round(avg(hit), 6) AS hit, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank FROM m{k}""" for k in range(2, 7)),
    "quality_report": "WITH " + CHUNKS + "," + _SIZE + f", cp AS (SELECT *, array_to_string(list_filter(string_split_regex(lower(coalesce(content, '')), '{WS}+'), lambda w: w <> ''), ' ') AS copy FROM sz0) SELECT count(*) AS chunks, count(DISTINCT section_title) AS sections, count(*) FILTER (WHERE section_title IS NULL) AS sectionless, count(*) FILTER (WHERE page_end > page_number) AS cross_page, count(*) FILTER (WHERE size < 100) AS small, count(*) FILTER (WHERE size > 320) AS large, count(*) FILTER (WHERE coalesce(source, '') = '') AS sourceless, count(*) - count(DISTINCT copy) AS surplus_copies FROM cp",
    "token_distribution": "WITH " + CHUNKS + "," + _SIZE + " SELECT CAST(min(size) AS INTEGER) AS min, median(size) AS median, round(avg(size), 6) AS mean, CAST(max(size) AS INTEGER) AS max FROM sz0",
    "block_type_histogram": "SELECT content_type, count(*) AS n FROM (SELECT DISTINCT block_id, content_type FROM blocks WHERE block_id IS NOT NULL) GROUP BY content_type",
    "smallest_chunks": "WITH " + CHUNKS + "," + _SIZE + " SELECT chunk_id, CAST(size AS INTEGER) AS size FROM sz0 ORDER BY size, chunk_id LIMIT 5",
    "oversized_chunks": "WITH " + CHUNKS + "," + _SIZE + " SELECT chunk_id, CAST(size AS INTEGER) AS size FROM sz0 WHERE size > 320 ORDER BY chunk_id LIMIT 5",
    "section_names": "SELECT DISTINCT section_title FROM chunks WHERE section_title IS NOT NULL AND chunk_id IS NOT NULL",
    "sample_positions": "WITH " + CHUNKS + ", s AS (SELECT source, list_sort(list_distinct(list(chunk_index))) AS a FROM ch GROUP BY source) SELECT DISTINCT source, a[CAST(least(floor(len(a) * q), len(a) - 1) AS INTEGER) + 1] AS chunk_index FROM s, (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) v(q)",
    "ingest_counters": r"WITH x AS (SELECT 'pages' AS what, page_id AS id, source FROM doc_pages UNION SELECT 'blocks', block_id, source FROM blocks UNION SELECT 'refs', ref_id, source FROM refs UNION SELECT 'chunks', chunk_id, source FROM chunks), y AS (SELECT what, regexp_replace(source, '(?i)\.pdf$', '') AS source FROM x WHERE id IS NOT NULL AND source IS NOT NULL) SELECT source, count(*) FILTER (WHERE what = 'pages') AS pages, count(*) FILTER (WHERE what = 'blocks') AS blocks, count(*) FILTER (WHERE what = 'refs') AS refs, count(*) FILTER (WHERE what = 'chunks') AS chunks FROM y GROUP BY ROLLUP (source)",
    "point_ids": "WITH " + CHUNKS + ", h AS (SELECT chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || ':' || page_number || ':' || chunk_index)) AS d FROM ch) SELECT chunk_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS point_id FROM h",
    "greedy_dedup": _RBASE + _greedy("bm", 5, 15) + " SELECT query_id, CAST(rank AS INTEGER) AS rank, doc, score FROM bm_g",
    "dense_retrieve": _RBASE + _VECTORS + "," + _greedy("dn", 5, 15) + " SELECT query_id, CAST(rank AS INTEGER) AS rank, doc, score FROM dn_g",
    "hybrid_topk": _RBASE + _VECTORS + "," + _HYBRID + f" SELECT query_id, CAST(rank AS INTEGER) AS rank, {s_squeeze('content')} AS content, source, page_number AS page, chunk_index, score AS vector_score, rerank_score FROM hy JOIN tk USING (doc)",
    "candidate_sweep": _RBASE + _JUDGE + _VECTORS + "," + _greedy("dn", 5, 30) + "," + ", ".join(f"""p{n} AS (SELECT s.query_id, u.i AS rank, s.kept[u.i] AS doc FROM dn_s s, unnest(range(1, len(kept) + 1)) AS u(i) WHERE s.stp = {n}), b{n} AS ({_placed_sql(f'p{n}')}), a{n} AS ({_placed_sql(f'({_rerank_sql(f"p{n}")})')})""" for n in _SWEEP) + " " + " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS candidates, '{step}' AS step, {_MEANS} FROM ({_metric('@.page_number', 'g.page_number = r.page_number', 'true', ranked=f'{t}{n}')})" for n in _SWEEP for t, step in (("b", "before"), ("a", "after"))),
    "dense_against_rerank": _RBASE + _JUDGE + _VECTORS + "," + _greedy("dn", 12, 36) + f", d1 AS ({_placed_sql('(SELECT * FROM dn_g WHERE rank <= 5)')}), d2 AS ({_placed_sql(f'({_rerank_sql("dn_g")})')}) " + " UNION ALL ".join(f"SELECT '{w}' AS way, {_MEANS} FROM ({_metric('@.page_number', 'g.source = r.source AND g.page_number = r.page_number', 'r.source = o.gs', ranked=t)})" for w, t in (("dense", "d1"), ("reranked", "d2"))),
    "hybrid_evaluation": _RBASE + _JUDGE + _VECTORS + "," + _HYBRID + f", d1 AS ({_placed_sql('(SELECT * FROM dn_g WHERE rank <= 5)')}), d2 AS ({_placed_sql(f'({_rerank_sql("dn_g")})')}), d3 AS ({_placed_sql('hy')}) " + " UNION ALL ".join(f"SELECT '{w}' AS way, {_MEANS} FROM ({_metric(*_PAIR, ranked=t)})" for w, t in (("dense", "d1"), ("dense_rerank", "d2"), ("hybrid", "d3"))),
    "parent_ids": "WITH " + CHUNKS + " SELECT chunk_id, CASE WHEN len(section_path) > 0 THEN 'P-' || left(sha1(source || '::' || array_to_string(section_path, ' > ')), 12) END AS parent FROM ch",
    "embedding_texts": "WITH c AS (SELECT DISTINCT chunk_id, content, section_path, embedding_text FROM chunks WHERE chunk_id IS NOT NULL) SELECT chunk_id, md5(CASE WHEN len(section_path) > 0 THEN 'Section: ' || array_to_string(section_path, ' > ') || chr(10) || chr(10) || content ELSE content END) AS built, md5(coalesce(nullif(embedding_text, ''), content)) AS used FROM c",
    "upsert_merge": "WITH c AS (SELECT source, page_number, chunk_index, bool_or(chunk_id % 2 = 0) AS a, bool_or(chunk_id % 3 = 0) AS b FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1, 2, 3) SELECT source, count(*) AS points, count(*) FILTER (WHERE b) AS changed FROM c WHERE a OR b GROUP BY source",
}
