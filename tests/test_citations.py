import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.operators import citations as C

EVIDENCE = [(1, "E1", "a.pdf", 3, [24]), (1, "E2", "a.pdf", 5, []), (1, "E3", "b.pdf", 2, [10, 11])]
SCHEMA = "query_id int, id string, source string, page_number int, reference_numbers array<int>"


def render(spark, answer):
    e = spark.createDataFrame(EVIDENCE, SCHEMA)
    return C.render(spark.createDataFrame([(1, answer)], "query_id int, answer string"), e).first().rendered


def test_rendering(spark):
    assert render(spark, "Claim [E1].") == "Claim [a.pdf, ref 24]."
    assert render(spark, "Both [E1, E2].") == "Both [a.pdf, ref 24] [a.pdf, page 5]."
    assert render(spark, "Side [E1][E2].") == "Side [a.pdf, ref 24][a.pdf, page 5]."
    assert render(spark, "Two [E3].") == "Two [b.pdf, ref 10] [b.pdf, ref 11]."
    mixed = render(spark, "Mixed [E1, E2][E3] and [E1; E9].")
    assert "[E1; E9]" in mixed and not re.search(r"\[E[123]\]", mixed)
    assert render(spark, "Run [E1] [E1] [E2].") == "Run [a.pdf, ref 24] [a.pdf, page 5]."


def expand(spark, rows):
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "i int, t string, k array<int>")
    return [x.o for x in df.select("i", C.expand_numbers(F.col("t"), F.col("k")).alias("o")).orderBy("i").collect()]


def spec(t, known):
    out = []
    for p in t.split(","):
        p = p.strip()
        m = re.fullmatch(r"(\d+)\s*-\s*(\d+)", p)
        if m:
            out += [n for n in sorted(known) if int(m[1]) <= n <= int(m[2])]
        elif re.fullmatch(r"\d{1,9}", p) and int(p) in known:
            out.append(int(p))
    return out


def test_expansion(spark):
    rows = [("1, 3-5", [1, 2, 3, 4]), ("5-3", [3, 4, 5]), ("1-2-3", [1, 2, 3]), ("2,2", [2]), ("", [1]), ("1-99999999999999", [7])]
    assert expand(spark, rows) == [[1, 3, 4], [], [], [2, 2], [], [7]]
    assert expand(spark, rows) == [spec(*r) for r in rows]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0123456789-, ", max_size=9), min_size=20, max_size=40))
def test_expansion_property(spark, texts):
    known = [1, 2, 3, 5, 8, 13]
    assert expand(spark, [(t, known) for t in texts]) == [spec(t, known) for t in texts]


def test_normalisation(spark):
    df = spark.createDataFrame([("see [24] and [25].",), ("both [24, 25]",), ("none [99] [x]",)], "t string")
    out = [x.o for x in df.select(C.normalize(F.col("t"), F.lit("s.pdf"), F.array(F.lit(24), F.lit(25))).alias("o")).collect()]
    assert out == ["see [s.pdf, ref 24] and [s.pdf, ref 25].", "both [s.pdf, ref 24] [s.pdf, ref 25]", "none [99] [x]"]


def test_marks_move_behind_citations(spark):
    df = spark.createDataFrame([("It ends. [s.pdf, ref 2] Next one.",)], "t string")
    assert df.select(C.before_marks(F.col("t")).alias("o")).first().o == "It ends [s.pdf, ref 2]. Next one."


AFTER = re.compile(r"([.!?])\s+((?:\[[^]]+?\.pdf,\s*ref\s+\d+\]\s*)+)(?=[A-Z0-9])", re.I)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["[s.pdf, ref 2]", "[S.PDF,ref 11]", "[x", ". ", "! ", ".", " ", "\n", "a", "B", "7", "]", "é"]), max_size=14).map("".join), min_size=30, max_size=60))
def test_one_pass_moves_all_citations(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.o for r in df.orderBy("i").select(C.before_marks(F.col("t")).alias("o")).collect()]
    want = []
    for t in texts:
        while True:
            new = AFTER.sub(lambda m: f" {m[2].strip()}{m[1]} ", t)
            if new == t:
                break
            t = new
        want.append(t)
    assert got == want


def test_runs_of_citations(spark):
    assert render(spark, "[see x, page 3] [see x, page 3]") == "[see x, page 3] [see x, page 3]"
    assert render(spark, "[A.pdf, ref 1] [a.PDF,  ref 2] [a.pdf, REF 1] [b.pdf, page 1]") == "[A.pdf, ref 1] [a.PDF,  ref 2] [b.pdf, page 1]"


def test_evidence_and_bibliography(spark):
    ranked = spark.createDataFrame([(1, 1, "s.pdf", 4, "One fact [1]. Another [9]. Third. [1] Last"), (1, 2, "t.pdf", 2, "Plain [1].")], "query_id int, rank int, source string, page_number int, content string")
    refs = spark.createDataFrame([("s.pdf", 1, "First"), ("s.pdf", 2, "Second")], "source string, number int, content string")
    e = C.build_evidence(ranked, refs)
    rows = [(x.id, x.content, x.reference_numbers) for x in sorted(e.collect(), key=lambda x: int(x.id[1:]))]
    assert rows[0] == ("E1", "One fact .", [1]) or rows[0] == ("E1", "One fact.", [1])
    assert [r[2] for r in rows] == [[1], [], [1], [], []]
    answers = C.render(spark.createDataFrame([(1, "So [E1] and [E2].")], "query_id int, answer string"), e)
    assert [(x.source, x.number, x.content) for x in C.final_bibliography(answers, refs).collect()] == [("s.pdf", 1, "First")]
    q = spark.createDataFrame([(1, "Why?")], "query_id int, text string")
    prompt = C.prompts(q, e).first().prompt
    assert "\n\nEvidence:\nE1\nOne fact" in prompt and "\n\n---\n\nE2\n" in prompt
