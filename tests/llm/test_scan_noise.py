import random
import re
import time

import pytest

from marginalia.llm import scan_noise as S
from marginalia.operators.running import PAGES

PAGE = "row_id bigint, source string, page_number int, content string, extra string"
BLOCK = "row_id bigint, source string, page_number int, pos int, content string"


def test_skeletons_of_confusions():
    for right, wrong in [("oscillates", "o5cillates"), ("polymer", "polyrner"), ("interview", "intervievv"), ("chemical", "cliemical"), ("reduces", "recluces"), ("interface", "iriterface"), ("boundary", "boiindary"), ("placebo", "place6o"), ("metallic", "mefallic"), ("matrix", "matr!x"), ("inhibe", "inhibc")]:
        assert S.skeleton(right) == S.skeleton(wrong), right
    assert S.skeleton("polymer") != S.skeleton("polymmer") and S.skeleton("cat") != S.skeleton("dog")


def test_page_numbers():
    for line, page in [("7", 7), ("p. 7", 7), ("- 12 -", 12), ("[3]", 3), ("Page 2 of 9", 2), ("| 4", 4), ("iv", 4), ("IX", 9)]:
        assert S.is_page_number(line, page), line
    for line, page in [("8", 7), ("7 8", 7), ("seven", 7), ("", 7), ("7", None), ("i", 2)]:
        assert not S.is_page_number(line, page), line


def test_lines_and_paragraphs(spark):
    body = "The polymer oscillates under load and the\nsignal-to-noise ratio stays high. The polymer oscillates.\n"
    pages = [(p, "s", p, f"Journal of Tests, Vol. {p}\n\n{'ab' * p} one\n{'cd' * p} two\n{body * 6}{'ef' * p} three\n{'gh' * p} four\n{p}", "x") for p in range(1, 6)]
    pages.append((6, "s", 6, "Journal of Tests, Vol. 6\nThe polyrner oscil-\nlates with a signal-\nto-noise ratio and it osc¬\n6", "x"))
    pages.append((7, "s", 7, "Journal of Tests, Vol. 7\nillates again under load.\n7", "x"))
    pages += [(8, "t", 1, None, "x"), (9, None, None, "", "x"), (10, "t", 2, "word " * 20000, "x")]
    p = spark.createDataFrame(pages, PAGE)
    b = spark.createDataFrame([(1, "s", 6, 0, "A text oscil-"), (2, "s", 6, 1, "lates here"), (3, "s", 6, 2, None)], BLOCK)
    found, _ = S.noisy_lines(p, b)
    got = {tuple(r) for r in found.collect()}
    want = {("doc_pages", i, 1, "header") for i in range(1, 8)} | {("doc_pages", i, len(pages[i - 1][3].split("\n")), "page_no") for i in range(1, 8)}
    want |= {("doc_pages", 6, 2, "misread"), ("doc_pages", 6, 2, "hyphen"), ("doc_pages", 6, 4, "hyphen"), ("blocks", 1, 1, "hyphen")}
    assert got == want
    text = {(r.page_number, r.n_parts): r.content for r in S.paragraphs(p, b).where("source = 's'").collect()}
    assert text[6, 2] == "The polymer oscillates with a signal-to-noise ratio and it oscillates again under load."


@pytest.mark.parametrize("lookup", [S.LOOKUP_FORMS, 0])
def test_paragraphs_of_blocks(spark, monkeypatch, lookup):
    monkeypatch.setattr(S, "LOOKUP_FORMS", lookup)
    columns = f"{BLOCK}, y0 double, page_height double"
    rows = [(p, "s", p, 0, f"Tests, Vol. {p}", 2.0, 100.0) for p in range(1, 7)]
    rows += [(10, "s", 2, 1, "The polymer\noscillates. " * 15 + "A signal-to-noise ratio.", 40.0, 100.0)]
    rows += [(11, "s", 2, 2, "A polyrner that oscil-\nlates is a poly-", 60.0, 100.0), (12, "s", 2, 3, "Page 2", None, None), (13, "s", 2, 4, "ii", 97.0, 100.0)]
    rows += [(14, "s", 3, 1, "mer that rests under", 30.0, 100.0), (15, "s", 3, 2, "signal-\nto-noise load.", 50.0, 100.0), (16, "s", 3, 3, "3", 50.0, 100.0)]
    rows += [(17, None, 3, 1, "no source and", 50.0, 100.0), (18, None, 3, 2, "nothing goes on", 50.0, 100.0), (19, "s", 4, 1, None, 50.0, 100.0), (None, "s", 4, 2, "x", 50.0, 100.0)]
    # Over the border of page ranges.
    rows += [(20, "r", PAGES - 1, 5, "The first part and", 50.0, 100.0), (21, "r", PAGES, 0, "the second part.", 50.0, 100.0)]
    pages = [(10, "s", 2, "Only a page.", "x")]
    got = {(r.tbl, r.row_id): (r.page_number, r.n_parts, r.content) for r in S.all_paragraphs(spark.createDataFrame(pages, PAGE), spark.createDataFrame(rows, columns)).collect()}
    assert got == {
        ("doc_pages", 10): (2, 1, "Only a page."),
        ("blocks", 10): (2, 1, "The polymer oscillates. " * 15 + "A signal-to-noise ratio."),
        ("blocks", 11): (2, 3, "A polymer that oscillates is a polymer that rests under signal-to-noise load."),
        ("blocks", 16): (3, 1, "3"),
        ("blocks", 17): (3, 1, "no source and"),
        ("blocks", 18): (3, 1, "nothing goes on"),
        ("blocks", 20): (PAGES - 1, 2, "The first part and the second part."),
    }


def test_empty_tables(spark):
    found, forms = S.noisy_lines(spark.createDataFrame([], PAGE), spark.createDataFrame([], BLOCK))
    assert found.count() == 0 and forms.count() == 0


def test_the_next_running_line_may_be_far_off(spark):
    body = "The polymer oscillates under load. " * 3
    rows = [(0, "s", 1, 0, body), (1, "s", 2, 0, "It is a poly-")]
    rows += [(i, "s", 2 + i, 0, "TABLE 1 2 3") for i in range(2, 40)]
    rows += [(50, "s", 300, 0, "mer that oscillates."), (60, None, 1, 0, "no source, a poly-"), (61, None, 2, 0, "mer.")]
    b = spark.createDataFrame(rows, BLOCK)
    broken = S._across(S._read_lines(b.withColumn("x", b.row_id), None, 0).where("what = 'edge'").select("row_id", "source", "page_number", "pos", "line_no", "a", "b", "mark"))
    assert {r.row_id: (r.b, r.next_row) for r in broken.collect()} == {1: ("mer", 50), 60: ("", None)}


def test_short_ways_give_what_the_whole_text_gives():
    r = random.Random(3)
    broken = re.compile(f"[^\\s]*[^\\W\\d_][{S.MARKS}][ \t]*\n\\s*[^\\s]*")
    fold = S.transducer().apply
    pieces = ["word", "wo", "Ünï", "été", "12", "3", "水压", "​", "\xa0", "!", "_", ".", "​́", "ｗｉｄｅ", "osc​il"] + [*S.MARKS] * 2
    for _ in range(4000):
        text = "".join(r.choice([*pieces, " ", " ", "\n", "\n", " \n", "\t", "-\n", "¬ \n", "a-\n"]) for _ in range(r.randrange(1, 24)))
        assert S._unbroken(text).split() == broken.sub(" ", text).split(), text
        raw = text.split("\n")
        whole = {i: words for i, words, _ in S._words_of(*S._lines(text))}
        for i in range(len(raw)):
            assert dict(S._line_words(raw, [i])) == ({i: whole[i]} if i in whole else {}), (text, i)
            head = S._head.match(fold(raw[i]))
            assert S._first_word(raw[i]) == (head[1] if head else None), text
            line = raw[i].rstrip()
            if line and line[-1] in S.MARKS:
                m = S._tail.search(fold(line[:-1]) + "-")
                assert S._last_part(line) == (m[1] if m else None), text


def test_a_stretch_without_spaces_is_passed_once():
    began = time.process_time()
    assert S._unbroken("x" * 50_000 + " poly-\nmer y") == "x" * 50_000 + "   y"
    assert time.process_time() - began < 2


def test_words_are_looked_up_in_one_pass(spark):
    b = spark.createDataFrame([(1, 1, "oscil", "lates", "-", 1, 2), (2, 1, "signal", "to", "-", 2, 2)], "row_id bigint, line_no int, a string, b string, mark string, next_row bigint, next_no int")
    counts = spark.createDataFrame([("oscillates", 5, True), ("signal-to", 4, True)], "form string, n bigint, mixed boolean")
    out = S._hyphen_lines(b, S._known_words(counts))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and [r.row_id for r in out.collect()] == [1]
