import random
import re
from collections import defaultdict
from itertools import combinations

from marginalia.llm import running_lines as R

BLOCK = "block_id bigint, source string, page_number int, block_index int, content string, y0 double, page_height double, edge string"


def form(c):
    return re.sub("[0-9]+", "#", c.lower())


def edge(y, h):
    return None if y is None or h is None else y < 0.12 * h or y >= (1 - 0.12) * h


def brute(rows, least=3, share=0.3):
    pages, on = defaultdict(set), defaultdict(set)
    for _, s, p, _, c, y, h, _ in rows:
        if s is not None:
            pages[s].add(p)
            if c is not None and edge(y, h):
                on[s, form(c)].add(p)
    hit = {k for k, v in on.items() if len(v) >= least and len(v) >= share * len(pages[k[0]]) - 1e-9}
    return {b for b, s, _, _, c, y, h, _ in rows if b is not None and s is not None and c is not None and (s, form(c)) in hit and edge(y, h) in (True, None)}


def make(seed=1):
    r = random.Random(seed)
    rows = []
    for s in ("a", "b", None):
        for p in range(1, 12):
            for k in range(4):
                y = r.choice([5.0, 50.0, 95.0, 88.0, 12.0, None])
                rows.append((len(rows), s, p, k, r.choice(["Head 1", "HEAD 22", "Foot", "", None, f"body {r.random()}"]), y, r.choice([100.0, 100.0, None]), "x"))
    return rows


def test_blocks_against_brute_force(spark):
    for seed in (1, 2):
        rows = make(seed)
        got = [r.block_id for r in R.repeated_line_blocks(spark.createDataFrame(rows, BLOCK)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_sequences_against_brute_force(spark):
    rows = [r for r in make(4) if r[1] and r[4] is not None and edge(r[5], r[6])]
    df = spark.createDataFrame(make(4), BLOCK)
    found = R.prefix_span(R.edge_lines(df).where("edge"), R.support_table(df, 3, 0.3), 3).collect()
    by = defaultdict(list)
    for _, s, p, k, c, *_ in sorted(rows, key=lambda r: r[3]):
        by[s, p].append(form(c))
    pages = {s: 11 for s in ("a", "b")}
    want = defaultdict(set)
    for (s, p), seq in by.items():
        for n in (1, 2, 3):
            for t in set(combinations(seq, n)):
                want[s, t].add(p)
    want = {k: len(v) for k, v in want.items() if len(v) >= max(3, 0.3 * pages[k[0]])}
    assert sorted(len(r.sequence) for r in found) == sorted(len(k[1]) for k in want) and sorted(r.pages for r in found) == sorted(want.values())


def test_sequences_of_any_length(spark):
    lines = ["Head", "Volume 1", "Foot", "Notice", "Page 1"]
    rows = [(9 * p + k, "a", p, k, c, 1.0 if k < 2 else 99.0, 100.0, "x") for p in range(1, 5) for k, c in enumerate(lines)]
    df = spark.createDataFrame(rows, BLOCK)
    found = R.prefix_span(R.edge_lines(df).where("edge"), R.support_table(df, 3, 0.3)).collect()
    assert sorted(len(r.sequence) for r in found) == sorted(n for n in range(1, 6) for _ in combinations(lines, n)) and {r.pages for r in found} == {4}


def test_empty_and_clean(spark):
    df = spark.createDataFrame([], BLOCK)
    assert R.repeated_line_blocks(df).count() == 0 and R.without_repeated_lines(df).count() == 0
    rows = make(1)
    assert R.without_repeated_lines(spark.createDataFrame(rows, BLOCK)).count() == len(rows) - len(brute(rows))
