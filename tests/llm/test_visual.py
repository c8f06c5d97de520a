import unicodedata

import pytest

from marginalia.llm.visual import Transducer, canonical_text, one_form, rules, visual_classes, visual_keys, visual_twins


def test_looks_are_one_form():
    same = [("ﬁne", "fine"), ("Ａ１", "A1"), ("a b c", "a b c"), ("re​ad", "read"), ("сору", "copy"), ("é", "é"), ("Å", "Å"), ("ё", "ë"), ("fu\xad\nr", "fu-\nr"), ("и̂", "и̂"), ("о́k", "ók")]
    for a, b in same:
        assert one_form(a) == one_form(b), (a, b)
    for a, b in [("a", "A"), ("e", "é"), ("a b", "a\nb"), ("a.", "a"), ("！", "!"), ("ν", "n"), ("0", "O"), ("1", "l")]:
        assert one_form(a) != one_form(b), (a, b)


def test_one_form_is_final():
    for o in [*range(0x20, 0x2000), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0)]:
        f = one_form(chr(o))
        assert one_form(f) == f and unicodedata.normalize("NFC", f) == f


def test_conflicts_are_refused():
    with pytest.raises(ValueError):
        Transducer(rules() | {"A": "a"})
    with pytest.raises(ValueError):
        Transducer(rules() | {"1": "l"})


def brute(rows):
    t = {i: c for i, c in rows if i is not None and c}
    return {(a, b) for a in t for b in t if a < b and t[a] != t[b] and one_form(t[a]) == one_form(t[b])}


def test_twins_against_brute_force(spark):
    rows = [(1, "copy"), (2, "сopy"), (3, "copy"), (3, "copy"), (4, "cоpy"), (5, ""), (6, None), (7, "Copy"), (8, "​"), (9, "\xa0"), (10, " "), (None, "copy"), (11, "long " * 5000), (12, "long " * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, content string, key string")
    got = [tuple(x) for x in visual_twins({"t": visual_keys(df, "id", "content")}).collect()]
    assert len(got) == len(set(got)) and {x[1:] for x in got} == brute(rows)
    assert visual_twins({"t": visual_keys(df.limit(0), "id", "content")}).count() == 0


def test_a_text_that_most_rows_repeat(spark):
    df = spark.range(6000).selectExpr("id", "IF(id = 77, 'notісe', 'notice') AS content")
    assert visual_twins({"t": visual_keys(df, "id", "content")}).count() == 5999


def test_many_copies_of_two_looks_alike(spark):
    df = spark.range(60).selectExpr("id", "IF(id % 2 = 0, 'notісe', 'notice') AS content")
    keys = {"t": visual_keys(df, "id", "content")}
    got = {tuple(r) for r in visual_twins(keys).select("id_a", "id_b").collect()}
    assert len(got) == 2 * 30 * 8 - 8 * 8 and all((a + b) % 2 for a, b in got)
    rows = visual_classes(keys).collect()
    assert len(rows) == 60 and {(r.class_id, r.n_texts, r.n_records) for r in rows} == {(0, 2, 60)} and {(r.id % 2, r.text_id) for r in rows} == {(0, 0), (1, 1)}


def test_letters_that_stay_apart():
    for c in "lIO0éè‘’“-–—":
        assert one_form(c) == c
    with pytest.raises(ValueError):
        Transducer(rules() | {"é": "e"})


def test_nulls_stay(spark):
    df = spark.createDataFrame([(None,), ("",), ("ﬂ",)], "c string")
    assert [r.canonical for r in canonical_text(df, "c").collect()] == [None, "", "fl"]
