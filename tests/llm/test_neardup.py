import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from marginalia.llm import neardup as N


def sets(rows):
    return {k: frozenset(c.lower().split()) for k, c in {(t, i): c for t, i, c in rows if i is not None}.items() if c and c.strip()}


def brute(rows):
    s = sets(rows)
    return {(a[0], a[1], b[1]) for a in s for b in s if a[0] == b[0] and a[1] < b[1] and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])}


def make(seed, n=160):
    r = random.Random(seed)
    vocabulary = ["the", "of", "a"] + [f"w{i}" for i in range(40)] + [f"KX-{i}" for i in range(500)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            w = rows[r.randrange(len(rows))][2].split()
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                k = r.randrange(len(w) + 1)
                w[k : k + r.choice([0, 1])] = [r.choice(vocabulary)] if r.random() < 0.6 else []
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 8, 13, 25, 60, 140, 400]))]
        rows.append((r.choice(["x", "y"]), i, " ".join(w) or "z"))
    return rows


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "e") for r in rows], "tbl string, id bigint, content string, doc string")
    got = [tuple(r) for r in N.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_pair_is_lost(spark, seed):
    rows = make(seed)
    rows += [("x", 900, None), ("x", 901, ""), ("x", 902, "  \n"), ("x", None, "w1 w2"), rows[3], rows[3], ("x", 903, "same text here"), ("x", 904, "same text here"), ("x", 905, "here same text")]
    assert pairs(spark, rows) == brute(rows)


def test_a_class_with_most_rows_stays_linear(spark):
    rows = [("x", i, "one two three four five six") for i in range(300)] + [("x", 300, "one two three four five SIX seven")]
    got = pairs(spark, rows)
    assert len(got) <= 301 * 2 * N.COPIES and {(0, i) for i in range(1, 300)} <= {p[1:] for p in got} and all(("x", i, 300) in got for i in range(300))


def test_groups(spark):
    rows = [("x", 1, "a b c d e f g h i j"), ("x", 2, "a b c d e f g h i k"), ("x", 3, "a b c d e f g h l k"), ("x", 4, "q"), ("x", 5, "q"), ("x", 6, "alone here"), ("x", 7, None)]
    df = spark.createDataFrame(rows, "tbl string, id bigint, content string")
    got = {r.id: (r.group_id, r.n_links) for r in N.near_duplicate_groups(df).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (4, 1), 5: (4, 1), 6: (6, 0)}


def test_empty(spark):
    df = spark.createDataFrame([], "tbl string, id bigint, content string")
    assert N.near_duplicate_pairs(df).count() == 0 and N.near_duplicate_groups(df).count() == 0


def test_hot_anchor_is_cut_into_blocks(monkeypatch):
    monkeypatch.setattr(N, "HOT", 40)
    w = N.Words()
    texts = [f"a b c d{i}" for i in range(150)]
    rows = pd.DataFrame(N.anchor_rows(np.zeros(150, np.int64), np.arange(150), [w.of(t) for t in texts])).assign(key=7)
    out = pd.concat(list(N._compare_sorted(iter([rows.iloc[i : i + 60] for i in range(0, len(rows), 60)]))))
    hot = out[out["kind"] == 1]
    assert len(hot) == len(rows) and hot["block"].max() == (len(rows) - 1) // 40
    whole = {tuple(p) for p in N.compare(N._matrix(rows, ("key", "doc", "f1", "f2")))}
    x, at, cut = N._matrix(hot, ("key", "a", "f1", "f2")), hot["block"].to_numpy(), set()
    for i in range(at.max() + 1):
        for j in range(i, at.max() + 1):
            cut |= {tuple(p) for p in (N.compare(x[at == i]) if i == j else N.compare(x[at == i], x[at == j]))}
    assert cut == whole


def test_pairs_across_the_borders_of_layouts(spark):
    r = random.Random(5)
    rows = []
    for small, large in [(11, 13), (12, 13), (12, 14), (12, 15), (104, 129), (104, 130), (103, 128), (105, 131)]:
        for _ in range(6):
            w = [f"{r.choice(['w', 'KX-', 'longer'])}{r.randrange(10**6)}" for _ in range(large)]
            rows += [("x", len(rows), " ".join(w)), ("x", len(rows) + 1, " ".join(r.sample(w, small)))]
    want = brute(rows)
    assert len(want) == 48 and pairs(spark, rows) == want


def test_a_long_chain_is_one_group(spark):
    n = 150
    edges = [("x", i, i + 1) for i in range(n)] + [("x", 900, 901), ("y", 5, 3), ("y", 4, 4)]
    got = {(r.tbl, r.node): r.root for r in N.components(spark.createDataFrame(edges, "tbl string, a bigint, b bigint")).collect()}
    assert got == {("x", i): 0 for i in range(n + 1)} | {("x", 900): 900, ("x", 901): 900, ("y", 3): 3, ("y", 5): 3}


def test_texts_of_one_key_are_told_apart(spark, monkeypatch):
    plain = N.text_key
    monkeypatch.setattr(N, "text_key", lambda seed: F.length("content").cast("bigint") if seed == 0 else plain(seed))
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [("x", 1, words), ("x", 2, words.replace("zeta", "ZETA")), ("x", 3, words.replace("theta", "thyme")), ("x", 4, words)]
    assert pairs(spark, rows) == brute(rows)


def test_unlike_rows_of_an_anchor_are_told_apart_early(monkeypatch):
    r = random.Random(8)
    w = N.Words()
    for sizes in ([5, 6, 7, 8], [13, 15, 17, 20], [60, 70, 80, 81, 90], [150, 180, 200], [40, 300]):
        vocabulary = [f"w{i}" for i in range(2 * max(sizes))]
        texts = [" ".join(r.sample(vocabulary, r.choice(sizes))) for _ in range(300)]
        texts += [" ".join(t.split()[:-1] + ["x"]) for t in texts[:40]]
        rows = pd.DataFrame(N.anchor_rows(np.zeros(len(texts), np.int64), np.arange(len(texts)), [w.of(t) for t in texts])).assign(key=7)
        x = N._matrix(rows, ("key", "doc", "f1", "f2"))
        x = x[np.unique(x[:, [1, 3]], axis=0, return_index=True)[1]]
        p, q = np.nonzero(np.triu(N._may_pair(x[:, None], x[None]), 1))
        want = {(min(u, v), max(u, v)) for u, v in zip(x[p, 1], x[q, 1])}
        asked, plain = [], N._may_pair
        monkeypatch.setattr(N, "_may_pair", lambda a, b: asked.append(len(a)) or plain(a, b))
        cut = {tuple(c) for c in N.compare(x[:170])} | {tuple(c) for c in N.compare(x[170:])} | {tuple(c) for c in N.compare(x[:170], x[170:])}
        monkeypatch.setattr(N, "_may_pair", plain)
        assert {tuple(c) for c in N.compare(x)} == want == cut and len(want) >= 20, sizes
        assert sum(asked) < len(x) ** 2 / 4, sizes


def test_sets_of_few_words_meet_by_equality():
    w = N.Words()
    texts = [f"a b{i}" for i in range(500)] + ["c d", "d c", "D  c"]
    rows = N.anchor_rows(np.zeros(503, np.int64), np.arange(503), [w.of(t) for t in texts])
    keys = pd.Series(rows["key"]).groupby(rows["doc"]).agg(list)
    assert keys[500] == keys[501] == keys[502] and len({k for x in keys[:501] for k in x}) == 501
