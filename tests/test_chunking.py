import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia import plugins
from marginalia.operators import chunking as C

sentence = st.lists(st.sampled_from("alpha beta gamma delta eps".split()), min_size=1, max_size=30).map(lambda w: " ".join(w).capitalize() + ".")


def test_v1_windows_and_overlap():
    words = [f"w{i}" for i in range(25)]
    got = C.pack_words(" ".join(words), 10, 3)
    assert got[0].split() == words[:10] and got[1].split()[:3] == words[7:10]
    assert C.pack_words("", 10, 3) == [] and C.pack_words("a b\n\nc", 10, 3) == ["a b c"]
    with pytest.raises(ValueError):
        C.pack_words("a", 5, 5)


@settings(max_examples=60, deadline=None)
@given(st.lists(sentence, max_size=30), st.integers(5, 40))
def test_v1_keeps_all_words_within_size(texts, size):
    text = "\n\n".join(texts)
    out = C.pack_words(text, size, 2)
    assert all(len(c.split()) <= size for c in out)
    assert set(text.split()) == {w for c in out for w in c.split()}


TOK = C.WordTokens()


class Counted(C.WordTokens):
    """The same sizes, but counted of the joined text every time."""

    additive = False


def units(texts):
    return [C.Unit(t, 1, len(TOK.encode(t))) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(sentence, max_size=40), st.booleans(), st.booleans())
def test_v2_respects_the_most(texts, check, first):
    p = C.Packing(target=40, least=15, most=60, overlap_most=20, check_first=check)
    u = units(texts)
    packed = C.pack_units(u, p, TOK, first=first)
    merged = C.merge_small(packed, p, TOK)
    for c in packed + merged:
        assert c.size == len(TOK.encode(c.text)) and (c.size <= p.most or len(c.units) == 1)
    assert {x.text for x in u} == {x.text for c in merged for x in c.units}
    assert merged == C.merge_small(C.pack_units(u, p, Counted(), first=first), p, Counted())


def test_overlap_is_emitted_alone_at_the_end_and_glued_back():
    p = C.Packing(target=6, least=5, most=20, overlap_most=6)
    packed = C.pack_units(units(["One two three.", "Four five six."]), p, TOK)
    assert [c.text for c in packed] == ["One two three. Four five six.", "Four five six."]
    assert [c.text for c in C.merge_small(packed, p, TOK)] == ["One two three. Four five six. Four five six."]


def test_overlap_limit_is_that_of_the_pipelines():
    assert C.V2.overlap_most == C.V2_BLOCK.overlap_most == 40
    long, short = " ".join(["w"] * 41), " ".join(["w"] * 40)
    p = C.Packing(target=50, least=1, most=90)
    assert len(C.pack_units(units([short, long, "end."]), p, TOK)[1].units) == 1
    assert len(C.pack_units(units([long, short, "end."]), p, TOK)[1].units) == 2


def test_windows_keep_all_text():
    t = "one, two; three (four) five."
    assert "".join(C.token_windows(t, 3, TOK)).replace(" ", "") == t.replace(" ", "")
    assert [u.size for u in C.cut_units("a b c d e f g", 1, 3, TOK, whole=True)] == [3, 3, 1]


def test_headings_of_paragraphs(spark):
    rows = ["2.1. Setup", "Results", "2020 saw growth.", "plain text", "1 " + "w " * 20, "", None, "3) Cases"]
    got = [r.h for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(C.heading(F.col("t")).alias("h")).collect()]
    assert got == ["2.1 Setup", "Results", "2020 saw growth.", None, None, None, None, "3 Cases"]


def brute_basic(paragraphs):
    """One document's chunks by the plain rules, section breaks within one loop."""
    p, held, title, out = C.V2, [], None, []
    size = lambda x: sum(u.size for u, _ in x)
    keep = lambda: held[-1:] if held and held[-1][0].size <= p.overlap_most else []
    for text, is_heading in paragraphs:
        if is_heading:
            title = text
            continue
        for u in C.cut_units(text, 1, p.most, TOK, whole=True):
            if not held:
                held = [(u, title)]
                continue
            changed = held[-1][1] != title
            if changed or size(held) + u.size > p.most:
                out.append(held)
                held = [] if changed or size(keep()) + u.size > p.most else keep()
            held = [*held, (u, title)]
            if size(held) >= p.target:
                out.append(held)
                held = keep()
    out += [held] if held else []
    merged = []
    for c in out:
        if merged and size(c) < p.least and merged[-1][0][1] == c[0][1] and size(merged[-1]) + size(c) <= p.most:
            merged[-1] = merged[-1] + c
        else:
            merged.append(c)
    return [(c[0][1], " ".join(u.text for u, _ in c)) for c in merged]


def test_sections_packed_apart_equal_one_loop(spark):
    import random

    r = random.Random(3)
    docs = []
    for d in range(25):
        docs.append([(f"{r.randint(1, 3)} Part", True) if r.random() < 0.4 else (" ".join(f"w{r.randint(0, 9)}" for _ in range(r.choice([5, 30, 45, 100, 230, 260, 310, 400]))) + ".", False) for _ in range(r.randint(1, 14))])
    pages = spark.createDataFrame([(f"d{i}", 1, "\n\n".join(t for t, _ in d)) for i, d in enumerate(docs)], "source string, page_number int, content string")
    got = {}
    for x in C.chunk_v2_basic(pages).orderBy("source", "chunk_index").collect():
        got.setdefault(x.source, []).append((x.section_title, x.content))
    assert got == {f"d{i}": brute_basic(d) for i, d in enumerate(docs) if brute_basic(d)}


def test_pipelines_run_and_registry(spark):
    text = [("s", 1, "1 Intro\n\n" + "Some words are here. " * 60), ("s", 2, "More words follow now. " * 90 + "\n\nReferences"), ("s", 3, "1. First one. 2. Second,\n3 of 4. 3. Third"), ("t", 1, "Short."), ("t", 2, "[1] is no entry"), (None, 1, "x"), ("u", 1, None)]
    pages = spark.createDataFrame([(*x, "clash") for x in text], "source string, page_number int, content string, pos string")
    for name in ("v1", "v2"):
        done = plugins.create(name).ingest(pages)
        rows = done.chunks.orderBy("source", "chunk_index").collect()
        assert [r.chunk_index for r in rows if r.source == "s"] == list(range(sum(r.source == "s" for r in rows)))
        # The heading stands at the end of a page, its first entry on the next one.
        assert sorted(tuple(r) for r in done.references.collect()) == [("s", 1, "First one."), ("s", 2, "Second, 3 of 4."), ("s", 3, "Third")]
    block = "source string, page_number int, pos int, content string, font_size double, is_bold boolean, y0 double, y1 double, page_height double"
    rows = [("s", 2, 0, "1 Intro", 12.0, True), ("s", 2, 1, "Some words are here. " * 70, 10.0, False), ("s", 3, 0, "2 Next", 12.0, True), ("s", 3, 1, "2.1 Inner part. End.", 10.0, False), ("s", 3, 2, "page 3 of 9", 10.0, False), ("s", 4, 0, "References", 12.0, True), ("s", 4, 1, "[1] Entry.", 10.0, False), (None, 1, 0, "x", 1.0, False)]
    done = plugins.create("v2-block").ingest(None, spark.createDataFrame([(*r, None, None, None) for r in rows], block))
    rows = done.chunks.orderBy("chunk_index").collect()
    assert rows[-1].content == "End." and rows[-1].section_path == ["2 Next", "2.1 Inner part"] and rows[0].section_title == "1 Intro" and rows[-1].parent_id.startswith("P-")
    assert [tuple(r) for r in done.references.collect()] == [("s", 1, "Entry.")]
    assert plugins.names() == ["v1", "v2-basic", "v2-block"] and plugins.select(spark) == "v1"
    with pytest.raises(ValueError):
        plugins.create("nope")
    with pytest.raises(ValueError):
        plugins.register(" ", lambda: None)
    with pytest.raises(ValueError):
        plugins.create("v2-block").ingest(pages)


def test_pipelines_of_empty_tables(spark):
    pages = spark.createDataFrame([], "source string, page_number int, content string")
    for name in ("v1", "v2-basic"):
        done = plugins.create(name).ingest(pages)
        assert done.chunks.count() == 0 and done.references.count() == 0
