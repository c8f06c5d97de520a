import random
import re

from pyspark.sql import functions as F

from marginalia.operators import bibliography, layout


def fold(headings):
    """Independent rule: a heading of n number parts keeps n - 1 entries of the path before it."""
    path, out = [], []
    for h in headings:
        m = re.match(r"\d+(?:\.\d+)*", h)
        path = [*path[: m[0].count(".")], h] if m else [h]
        out.append(list(path))
    return out


def test_section_paths_equal_the_fold(spark):
    r = random.Random(5)
    rows, want = [], {}
    for s in ("a", "b"):
        path, k = [], 0
        for page in range(1, 9):
            for pos in range(6):
                kind = r.choice(["heading", "prose", "prose"])
                t = r.choice(["1 A", "2 B", "1.1 C", "2.3 D", "3.2.1 E", "1.2.3.4 F", "Intro", "Methods..."]) + ("" if r.random() < 0.5 else f" {k}") if kind == "heading" else "text"
                k += 1
                if kind == "heading":
                    h = re.sub(r"\.+$", "", " ".join(t.split()))
                    m = re.match(r"\d+(?:\.\d+)*", h)
                    path = [*path[: m[0].count(".")], h] if m else [h]
                want[s, page, pos] = list(path)
                rows.append((s, page, pos, t, kind))
    df = spark.createDataFrame(rows, "source string, page_number int, pos int, content string, kind string")
    got = {(x.source, x.page_number, x.pos): x.path for x in layout.section_paths(df).collect()}
    assert got == want
    titles = {(x.source, x.page_number, x.pos): x.section for x in layout.section_titles(df).collect()}
    assert titles == {k: (v[-1] if v else None) for k, v in want.items()}


def test_margins_need_three_pages_and_coordinates(spark):
    b = [("s", p, 0, f"Journal, Vol. {p}", 5.0, 11.0, 100.0) for p in (1, 2, 3)] + [("s", p, 1, "Body text", 50.0, 60.0, 100.0) for p in (1, 2, 3)] + [("s", 4, 0, "Journal, Vol. 9", None, None, 100.0), ("s", 4, 1, "Page 4", 50.0, 60.0, 100.0)]
    df = spark.createDataFrame(b, "source string, page_number int, pos int, content string, y0 double, y1 double, page_height double")
    assert [(x.signature, x.pages) for x in layout.margin_signatures(df).collect()] == [("journal, vol. <n>", 3)]
    left = {(x.page_number, x.content) for x in layout.without_margins(df).collect()}
    assert left == {(1, "Body text"), (2, "Body text"), (3, "Body text"), (4, "Journal, Vol. 9")}


def test_body_font_default(spark):
    df = spark.createDataFrame([("a", "one two", 9.0), ("b", "one two three four five", 8.0), ("b", "one two three four five", 12.0)], "source string, content string, font_size double")
    assert {x.source: x.body for x in layout.body_font_size(df).collect()} == {"a": 10.0, "b": 10.0}


def test_classes_in_order(spark):
    rows = [("Table 1 x", "table"), ("Fig. 2 y", "figure_caption"), ("Acknowledgements", "back_matter"), ("Received 1 May", "metadata"), ("3D printing is new", "heading"), ("Results", "heading"), (None, "prose"), ("plain words", "prose")]
    df = spark.createDataFrame([("s", 1, i, c, None, None) for i, (c, _) in enumerate(rows)], "source string, page_number int, pos int, content string, font_size double, is_bold boolean")
    assert [x.kind for x in layout.classify(df).orderBy("pos").collect()] == [k for _, k in rows]


def test_inline_headings_and_references(spark):
    df = spark.createDataFrame([("s", 1, 0, "2.1 Setup of it. Then text\n\nline"), ("s", 1, 1, " references "), ("s", 2, 0, "after")], "source string, page_number int, pos int, content string")
    assert [x.content for x in layout.split_inline_headings(df).where("page_number = 1 AND pos = 0").orderBy("piece").collect()] == ["2.1 Setup of it.", "Then text", "line"]
    assert [(x.page_number, x.pos) for x in layout.until_references(df).collect()] == [(1, 0)]


def test_spans(spark):
    s = [("s", 1, 0, 0, "Bold", "X-Bold", 12.0, 0, 1.0, 1.0, 2.0, 2.0, 9.0), ("s", 1, 0, 1, "text", "X", 10.0, 0, 1.0, 2.0, 3.0, 4.0, 9.0)]
    df = spark.createDataFrame(s, "source string, page_number int, block int, span int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, y1 double, page_height double")
    r = layout.spans_to_blocks(df).first()
    assert (r.content, r.font_size, r.is_bold, r.y0, r.y1) == ("Boldtext", 12.0, True, 1.0, 4.0)


def test_bibliography(spark):
    def parse(t):
        return [(x.number, x.content) for x in bibliography.entries(spark.createDataFrame([("s", t)], "source string, text string")).orderBy("number").collect()]

    assert parse("x References [1] A b.\n[2] C [d]. [4] E") == [(1, "A b."), (2, "C [d]."), (4, "E")]
    assert parse("References 1. A 12) b 2. C 7. d 3) E 3 of 9 12, 4, Downloaded from x") == [(1, "A 12) b"), (2, "C 7. d"), (3, "E")]
    assert parse("no bibliography [1] here") == []
    pages = spark.createDataFrame([("a", 1, "text"), ("a", 2, "tail References [1] x"), ("a", 3, "[2] y"), ("b", 1, "References 1) x"), ("c", 1, "References are good")], "source string, page_number int, content string")
    assert {(x.source, x.page_number, x.content.strip()) for x in bibliography.main_pages(pages).collect()} == {("a", 1, "text"), ("a", 2, "tail"), ("c", 1, "References are good")}
