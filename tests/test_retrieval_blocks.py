"""Search by blocks against plain sums."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from marginalia.operators import sparse


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.list_(pa.string()))], ["id", "t"])


def test_many_documents_and_ties():
    r = np.random.default_rng(3)
    docs = [(int(i), [f"w{int(x)}" for x in r.zipf(1.3, r.integers(1, 30)) if x < 3000]) for i in r.permutation(3000)]
    asked = [(q, [f"w{int(x)}" for x in r.zipf(1.3, 8) if x < 4000] + ["w1"]) for q in range(60)] + [(60, ["nowhere"])]
    df = Counter(w for _, t in docs for w in set(t))
    weight = {w: math.log(3000.5 - c) - math.log(c + 0.5) if c < 1000 else 0.5 for w, c in df.items()}
    avglen = sum(len(t) for _, t in docs) / 3000
    [q] = sparse._batches([batch(asked)])
    [b] = [x for x in sparse._blocks([batch(docs)])]
    terms = q.column("asked")[0].values
    q = q.append_column("has", pa.array([[i for i, w in enumerate(terms.to_pylist()) if w in weight]], pa.list_(pa.int32())))
    q = q.append_column("idf", pa.array([[weight[w] for w in terms.to_pylist() if w in weight]], pa.list_(pa.float64())))
    pair = pa.RecordBatch.from_arrays([*q.columns, *b.columns], [*q.schema.names, *b.schema.names])
    for k in (1, 6):
        got = {}
        for x in sparse._searched(avglen, k)(iter([pair])):
            for i, d, s in zip(*(c.to_pylist() for c in x.columns), strict=True):
                got.setdefault(i, []).append((d, s))
        for i, t in asked:
            s = {d: round(sum(n * weight.get(w, 0) * own[w] * 2.5 / (own[w] + 1.5 * (0.25 + 0.75 * len(u) / avglen)) for w, n in Counter(t).items()), 6) for d, u in docs for own in [Counter(u)]}
            want = sorted(s.items(), key=lambda x: (-x[1], x[0]))[:k]
            assert [d for d, _ in got[i]] == [d for d, _ in want]
            assert all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got[i], want, strict=True))


def test_documents_without_a_score_come_before_negative_ones(spark):
    docs = [(i, "a c") for i in range(1, 8)] + [(9, "b")]
    c, q = spark.createDataFrame(docs, "doc bigint, content string"), spark.createDataFrame([(1, "a")], "query_id bigint, text string")
    got = sparse.bm25_topk(sparse.build_index(c), q, 2).orderBy("rank").collect()
    assert [r.doc for r in got] == [9, 1] and got[0].score == 0 > got[1].score


def test_places_of_a_block_and_its_bounds():
    rows = [(i, ["x"] * (i % 4)) for i in range(10)]
    parts = list(sparse._gathered([batch(rows[:7]), batch(rows[7:])], 4, 5))
    assert [i for ids, _, _ in parts for i in ids] == list(range(10))
    assert all(len(ids) <= 4 and (len(flat) <= 5 or len(ids) == 1) and sum(each) == len(flat) for ids, each, flat in parts)


def test_dense_search_keeps_little_more_than_the_best():
    from marginalia.operators import dense

    q, s, d = np.array([1, 0, 1, 1, 0]), np.array([0.5, 0.1, 0.9, 0.5, 0.2]), np.array([7, 5, 9, 3, 4])
    assert [x.tolist() for x in dense._best(q, s, d, 2)] == [[0, 0, 1, 1], [0.2, 0.1, 0.9, 0.5], [4, 5, 9, 3]]


def test_hybrid_evaluation_searches_vectors_once(spark, monkeypatch):
    from pathlib import Path

    import pytest

    from marginalia.plans import retrieval

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("the driver's tables aren't here")
    calls, own = [], retrieval.dense.dense_retrieve
    monkeypatch.setattr(retrieval.dense, "dense_retrieve", lambda *a, **k: calls.append(1) or own(*a, **k))
    assert retrieval.hybrid_evaluation(spark, "/root/testdata/sf0.001").columns and len(calls) == 1


def test_metrics_pages_judges_every_question(spark):
    from pathlib import Path

    import pytest

    from marginalia.plans import retrieval
    from marginalia.plans.common import evidence

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("the driver's tables aren't here")
    want = evidence(spark, sf).where("content IS NOT NULL AND source IS NOT NULL AND page_number IS NOT NULL").count()
    assert retrieval.metrics_pages(spark, sf).count() == want > 50
