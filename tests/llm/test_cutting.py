import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import mixture, split


def n_units(t):
    return len(re.findall(split.UNIT, t))


@settings(max_examples=120, deadline=None)
@given(st.text("ab .,\n。字ไ", max_size=300), st.integers(3, 30), st.integers(0, 2))
def test_pieces_fit_cover_and_overlap(text, limit, overlap):
    p = split.pieces(text, limit, overlap)
    if not n_units(text):
        assert p == []
        return
    assert all(n_units(text[a:e]) <= limit for a, _, e in p)
    assert "".join(text[c:e] for _, c, e in p) == text
    if n_units(text) <= limit:
        assert len(p) == 1
    for a, c, _ in p[1:]:
        assert n_units(text[a:c]) == min(overlap, n_units(text[:c]))
    cores = [n_units(text[c:e]) for _, c, e in p]
    assert all(x + y + (overlap if i else 0) > limit for i, (x, y) in enumerate(zip(cores, cores[1:])))


def test_natural_boundaries_win():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven twelve."
    assert [text[c:e].strip() for _, c, e in split.pieces(text, 7, 0)] == ["One two three. Four five six.", "Seven eight nine. Ten eleven twelve."]
    with pytest.raises(ValueError):
        split.pieces("a", 5, 5)


def test_split_table(spark):
    rows = [(1, "a " * 50), (2, None), (3, ""), (4, " \n"), (5, "b"), (None, "c " * 50), (6, "x" * 100000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "id bigint, content string, piece int")
    got = split.split_items(df, "id", "content", 20, 5).collect()
    assert sum(r.id == 1 for r in got) >= 4 and {r.id for r in got} == {1, 5, 6} and all(r.units <= 20 for r in got)
    assert sorted(r.id or 0 for r in split.oversized(df, "content", 20).collect()) == [0, 1]


def test_mix_reaches_shares_within_caps(spark):
    docs = [(i, "a", 100) for i in range(400)] + [(1000 + i, "b", 100) for i in range(20)] + [(2000, "c", 5), (2001, "b", 0), (2002, None, 7)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.2, 3), ("none", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    m = mixture.mix(sized, targets, block_tokens=500)
    rows = m.collect()
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and {r.source for r in rows} == {"a", "b"}
    assert max(r.copy for r in rows if r.source == "a") == 1 and max(r.copy for r in rows if r.source == "b") == 3
    shares = {r.source: r for r in mixture.mix_shares(m, sized, targets).collect()}
    assert abs(shares["a"].share - 0.7 / 0.9) < 0.02 and shares["none"].tokens == 0
    first = [r.source for r in sorted(rows, key=lambda r: r.slot)][: len(rows) // 2]
    assert abs(first.count("a") / len(first) - 0.7 / 0.9) < 0.1
    big = mixture.mix_shares(mixture.mix(sized, targets, total_tokens=100_000, block_tokens=500), sized, targets).collect()
    assert {r.source: r.tokens for r in big}["b"] == 6000


def test_mix_holds_every_planned_document(spark):
    weights = [0.31, 0.2, 0.17, 0.11, 0.07, 0.05, 0.04, 0.03, 0.015, 0.005]
    docs = [(1000 * k + i, f"s{k}", 100) for k, w in enumerate(weights) for i in range(round(1000 * w))]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([(f"s{k}", w, 1 + k % 2) for k, w in enumerate(weights)], "source string, target_share double, max_repeats int")
    for total in (None, 120_000):
        wanted = {r.source: r.wanted for r in mixture.plan_mix(sized, targets, total).collect()}
        rows = mixture.mix(sized, targets, total_tokens=total, block_tokens=700).collect()
        got = {s: sum(r.tokens for r in rows if r.source == s) for s in wanted}
        assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and len({(r.slot, r.block) for r in rows}) == len({r.slot for r in rows})
        assert all(wanted[s] <= got[s] < wanted[s] + 100 for s in wanted), (wanted, got)


def test_empty_mix(spark):
    sized = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixture.mix(sized, targets).count() == 0
    assert [r.share for r in mixture.mix_shares(mixture.mix(sized, targets), sized, targets).collect()] == [0.0]
