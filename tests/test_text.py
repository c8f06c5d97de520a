import re
import unicodedata
import uuid

from pyspark.sql import functions as F

from marginalia.functions import ids, text, vectors

SAMPLES = [None, "", "  ", "Éa ça_1 x-y", "one. Two! three? Four 5. 6", "a-\nb c-\n d", "p1\nq\n\n\n p2\t x \n \n", "Page 3 of 9", "12", " x  y ", "1. Title...", "ﬁne Ａ１ x"]


def column(spark, f):
    rows = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, s string").select("i", f(F.col("s")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def each(f):
    return [None if s is None else f(s) for s in SAMPLES]


def test_strip_and_squeeze(spark):
    assert column(spark, text.strip) == each(str.strip)
    assert column(spark, text.squeeze) == each(lambda s: " ".join(s.split()))


def test_words_and_tokens(spark):
    assert column(spark, text.words) == each(str.split)
    assert column(spark, text.tokens) == each(lambda s: re.findall(r"\b\w+\b", s.lower()))
    assert column(spark, text.word_count) == [len((s or "").split()) for s in SAMPLES]


def test_sentences(spark):
    assert column(spark, text.sentences_strict) == each(lambda s: [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", s) if x.strip()])
    assert column(spark, text.sentences_loose) == each(lambda s: [x.strip() for x in re.split(r"(?<=[.!?])\s+", s) if x.strip()])


def test_dehyphenate_and_paragraphs(spark):
    assert column(spark, text.dehyphenate) == each(lambda s: re.sub(r"(?<=\w)-\s*\n\s*(?=\w)", "", s))
    assert column(spark, text.paragraphs) == each(lambda s: [p for p in (re.sub(r"[ \t]+", " ", x.replace("\n", " ")).strip() for x in re.split(r"\n\s*\n", s)) if p])


def test_nfkc_is_unicodes(spark):
    assert column(spark, text.nfkc) == each(lambda s: unicodedata.normalize("NFKC", s))


def test_page_numbers_and_noise(spark):
    assert [bool(x) for x in column(spark, text.is_page_number)] == [s in ("Page 3 of 9", "12") for s in SAMPLES]
    assert column(spark, text.clean_noise)[7:9] == ["", ""]


def test_jaccard_of_empty_is_zero(spark):
    rows = spark.createDataFrame([("a b", "B c"), ("", "a"), ("a", "a")], "a string, b string").select(text.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [round(r.j, 6) for r in rows] == [0.333333, 0.0, 1.0]


def test_ids(spark):
    names = [("a.pdf", 1, 0), ("Ünï.pdf", 12, 345), ("x", 999, 7)]
    rows = spark.createDataFrame(names, "s string, p int, i int").select(ids.point_id(F.col("s"), F.col("p"), F.col("i")).alias("u")).collect()
    assert [r.u for r in rows] == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{s}:{p}:{i}")) for s, p, i in names]
    assert spark.createDataFrame([("s", [])], "s string, p array<string>").select(ids.parent_id(F.col("s"), F.col("p")).alias("x")).first().x is None


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.norm(F.col("a")).alias("n"), vectors.l2_normalize(F.col("a")).alias("u")).collect()
    assert round(r[0].c, 9) == 0.96 and r[0].n == 5.0 and r[0].u == [0.6, 0.8] and r[1].c == 0.0 and r[1].u == [0.0, 0.0]
