import math
import re
from collections import Counter

import numpy as np

from marginalia.operators import alignment, dense, evaluation, ranking, sparse


def test_bm25_against_plain_python(spark):
    docs = {1: "a b b c", 2: "b c d", 3: "  ", 4: "e e e a", 5: "c", 6: None, 7: "b", 8: "b a"}
    queries = {1: "b b zz a", 2: "!!", 3: "c"}
    tok = {d: re.findall(r"\w+", t.lower()) for d, t in docs.items() if t and t.strip()}
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok)
    df = Counter(w for t in tok.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    want = {}
    for q, text in queries.items():
        words = re.findall(r"\w+", text.lower())
        if words:
            s = {d: round(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in words), 6) for d, t in tok.items()}
            want[q] = sorted(s.items(), key=lambda x: (-x[1], x[0]))[:5]
    c = spark.createDataFrame(list(docs.items()), "doc bigint, content string")
    q = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    got = {}
    for r in sparse.bm25_topk(sparse.build_index(c), q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc, r.score))
    assert {k: [d for d, _ in v] for k, v in got.items()} == {k: [d for d, _ in v] for k, v in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_vectors_in_blocks(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(999, None)], "doc bigint, vector array<double>")
    q = df.where("doc % 50 = 0").withColumnRenamed("doc", "query_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for block in (1000, 2):
        got = {}
        for x in dense.vector_topk(df, q, 4, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(x.doc)
        for k in (0, 50, 100, 150):
            s = np.round(u @ u[k], 6)
            assert got[k] == sorted(range(200), key=lambda i: (-s[i], i))[:4]
    assert dense.vector_topk(df, q.where("false"), 4).count() == 0


def greedy(rows, k):
    kept = []
    for r in rows:
        s = set(r[1].lower().split())
        if r[1] and len(kept) < k and not any(s and o and len(s & o) >= 0.8 * len(s | o) for _, o in kept):
            kept.append((r[0], s))
    return [d for d, _ in kept]


def test_greedy_dedup(spark):
    rows = [(1, "a b c d e"), (2, "A b c d e"), (3, "a b c d f"), (4, ""), (5, "x"), (6, "a b c d e f"), (7, "y z"), (8, "x")]
    df = spark.createDataFrame([(0, i + 1, d, c, 1.0) for i, (d, c) in enumerate(rows)], "query_id bigint, rank int, doc bigint, content string, score double")
    for k in (1, 3, 10):
        assert [x.doc for x in dense.greedy_dedup(df, k).orderBy("rank").collect()] == greedy(rows, k)


def test_rrf_counts_repeats_and_breaks_ties_by_first_seen(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "x")], "query_id int, rank int, doc string")
    b = spark.createDataFrame([(1, 1, "z"), (1, 2, "w")], "query_id int, rank int, doc string")
    rows = ranking.rrf_fuse([a, b], 9).orderBy("rank").collect()
    assert [r.doc for r in rows] == ["x", "z", "y", "w"] and rows[0].score == round(1 / 61 + 1 / 63, 9)


def test_rerank_and_search(spark):
    c = [(1, 1, 10, 0.9, "red fox", "a red hen", "A.pdf"), (1, 2, 11, 0.8, "red fox", "red fox", "b.pdf"), (1, 3, 12, 0.7, "red fox", "no", "a.pdf")]
    df = spark.createDataFrame(c, "query_id int, rank int, doc int, score double, text string, content string, source string")
    assert [x.doc for x in ranking.rerank(df, 2).orderBy("rank").collect()] == [11, 10]
    assert [x.doc for x in ranking.search(df, 99, " a.PDF ").orderBy("rank").collect()] == [10, 12]
    assert [x.doc for x in ranking.search(df, 0, None, 2).orderBy("rank").collect()] == [11]
    blank = df.selectExpr("query_id", "rank", "doc", "score", "' ' AS text", "content", "source")
    assert [(x.doc, x.rerank_score) for x in ranking.rerank(blank, 2).orderBy("rank").collect()] == [(10, None), (11, None)]


def test_metric_variants_differ(spark):
    ranked = spark.createDataFrame([(1, 1, "b", 1), (1, 2, "a", 1), (1, 3, "a", 2), (1, 4, "a", 1)], "query_id int, rank int, source string, page_number int")
    gold = spark.createDataFrame([(1, "a", 1), (1, "a", 9), (2, "a", 1)], "query_id int, source string, page_number int")
    m = {f.__name__: {r.query_id: (r.hit, round(r.precision, 4), r.recall, r.reciprocal_rank) for r in f(ranked, gold).collect()} for f in (evaluation.by_source_page, evaluation.by_single_source, evaluation.by_page_only)}
    assert m["by_source_page"] == {1: (1.0, 0.3333, 0.5, 0.5), 2: (0.0, 0.0, 0.0, 0.0)}
    assert m["by_single_source"][1] == (1.0, 0.5, 0.5, 0.5) and m["by_page_only"][1] == (1.0, 0.5, 0.5, 1.0)


def test_hard_negatives_against_brute_force(spark):
    refs = [("s", n) for n in (1, 2, 4, 5, 9, 10, 30)] + [("t", 3)]
    ev = [(1, "s", [4, 5]), (2, "s", [7]), (3, "s", [1, 2, 4]), (4, "t", [3]), (5, "s", [None, 30]), (6, "s", [])]
    r = spark.createDataFrame(refs, "source string, number int")
    e = spark.createDataFrame(ev, "ev_id bigint, source string, reference_numbers array<int>")
    got = {}
    for x in alignment.hard_negatives(e, r).orderBy("ev_id", "rank").collect():
        got.setdefault(x.ev_id, []).append(x.number)
    want = {}
    for i, s, c in ev:
        c = [n for n in c if n is not None]
        if c:
            rest = sorted((n for t, n in refs if t == s and n not in c), key=lambda n: (abs(n - c[0]), n))[:2]
            if rest:
                want[i] = rest
    assert got == want
