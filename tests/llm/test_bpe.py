import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.bpe import PrefixTable, encode_table, encoder, token_counts

sys.path.insert(0, "/opt/tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


HARD = ["", " ", "  a  b ", "\n\n \t x", "<|endoftext|>", "it's we'll I'VE", "½ Ⅷ ٣ 12345", "a" * 4000, " " * 300, "ไทยภาษา 中文字符 한국어", "👨‍👩‍👧 é", "\x1c\x85 　", "don't--stop… KX-36764"]


def test_hard_texts(reference):
    e = encoder()
    for s in HARD:
        assert e.encode(s) == reference(s), s


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(reference, s):
    assert encoder().encode(s) == reference(s) and encoder().count(s) == len(reference(s))


@settings(max_examples=150, deadline=None)
@given(st.text("abcdefghij ", min_size=1, max_size=20), st.integers(0, 20), st.integers(0, 20), st.text("abcxyz", max_size=6))
def test_append_and_splice_equal_a_new_table(s, a, b, new):
    v = encoder().memo.v
    data, lo, hi = s.encode(), min(a, b, len(s)), min(max(a, b), len(s))
    grown = PrefixTable(v)
    for k in range(len(data)):
        grown.append(data[k : k + 1])
    assert grown.ids == PrefixTable(v, data).ids == v.merged(data)
    grown.splice(lo, hi, new.encode())
    changed = data[:lo] + new.encode() + data[hi:]
    assert grown.ids == PrefixTable(v, changed).ids == v.merged(changed)


def test_table(spark, reference):
    rows = [(1, None), (2, ""), (3, "Two words"), (3, "Two words"), (4, HARD[7])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string")
    assert [(r.doc_id, list(r.ids)) for r in encode_table(df, "doc_id", "text").collect()] == [(i, reference(t or "")) for i, t in rows]
    assert [r.tokens for r in token_counts(df, "text").collect()] == [len(reference(t or "")) for _, t in rows]
    assert encode_table(df.limit(0), "doc_id", "text").count() == 0
