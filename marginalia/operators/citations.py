"""Citations in text: expansion, normalisation, evidence, rendering. Matches are rewritten with arrays:
a text is cut at the matches, these are transformed, and the pieces joined again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import sentences_strict, squeeze, strip

# Forms of citations.
NUMERIC = r"\[([0-9,\-\s]+)\]"
NORMALIZED = r"(?i)\[[^\]]+?\.pdf,\s*ref\s+\d+\]"
CITED = r"(?i)\[([^\]]+?\.pdf),\s*ref\s+(\d+)\]"
_ONE = r"\[[^\]]+?\.pdf,\s*ref\s+\d+\]"
AFTER_MARK = rf"(?iU)([.!?])\s+((?:{_ONE}\s*)*{_ONE})\s*(?=[A-Z0-9])"
GROUP = r"\[\s*(E\d+(?:\s*[,;]\s*E\d+)*)\s*\]"
RENDERED = r"(?iU)\[[^\[\]]+?\.pdf,\s*(?:ref\s+\d+|page\s+\d+)\]"


def replace_matches(text: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(gaps, F.transform(found, f), lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")


def expand_numbers(group: Column, known: Column) -> Column:
    """Numbers of ``1, 3-5``; ranges are met with the known numbers, so their width is no matter.

    Ranges that run backwards are empty, ``1-2-3`` and what is no number is ignored, the order and
    repetitions of single numbers stay.
    """

    def part(p: Column) -> Column:
        t = strip(p)
        a, b = F.regexp_extract(t, r"^(\d+)\s*-\s*(\d+)$", 1), F.regexp_extract(t, r"^(\d+)\s*-\s*(\d+)$", 2)
        single = F.filter(F.array(F.when(t.rlike(r"^\d{1,9}$"), t.cast("int"))), lambda n: n.isNotNull() & F.array_contains(known, n))
        return F.when(a != "", F.array_sort(F.filter(known, lambda n: (n >= a.cast("decimal(38,0)")) & (n <= b.cast("decimal(38,0)"))))).otherwise(single)

    return F.flatten(F.transform(F.split(group, ","), part))


def normalize(text: Column, source: Column, known: Column) -> Column:
    """``[1, 3-5]`` to ``[source, ref 1] [source, ref 3]...`` for known numbers; a group without any stays."""

    def one(m: Column) -> Column:
        numbers = expand_numbers(F.regexp_extract(m, NUMERIC, 1), known)
        return F.when(F.size(numbers) > 0, F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("["), source, F.lit(", ref "), n.cast("string"), F.lit("]"))), " ")).otherwise(m)

    return F.when(F.size(known) > 0, replace_matches(text, NUMERIC, one)).otherwise(text)


def before_marks(text: Column) -> Column:
    """Citations behind a final mark, with more text after them, go before it.

    One pass reaches the fixpoint: moved citations are followed by the mark, never by a letter or digit,
    so no run of citations that holds a moved one fits again, and every other one was met.
    """
    return F.regexp_replace(text, AFTER_MARK, " $2$1 ")


def cited(text: Column) -> Column:
    """Distinct array<struct<source, number>> of normalised citations, in order."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(CITED), F.lit(1)), F.regexp_extract_all(text, F.lit(CITED), F.lit(2)), lambda s, n: F.struct(strip(s).alias("source"), n.cast("int").alias("number")))
    return F.array_distinct(pairs)


def strip_citations(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, NORMALIZED, ""))


def build_evidence(ranked: DataFrame, refs: DataFrame) -> DataFrame:
    """Evidence of ranked chunks: query_id, id (E1...), content, source, page_number, reference_numbers.

    ranked: query_id, rank, source, page_number, content; refs: source, number. Sentences in rank
    order; numbers of the sentence's own source only; ids count kept sentences across a query.
    """
    known = refs.where("number IS NOT NULL").groupBy("source").agg(F.array_sort(F.collect_set("number")).alias("known"))
    r = ranked.join(known, "source", "left").withColumn("known", F.coalesce("known", F.array().cast("array<int>")))
    r = r.withColumn("text", before_marks(normalize(F.col("content"), F.col("source"), F.col("known"))))
    s = r.select("query_id", "rank", "source", "page_number", F.posexplode(sentences_strict(F.col("text"))).alias("n", "sentence"))
    own = F.filter(cited(F.col("sentence")), lambda c: c["source"] == F.col("source"))
    s = s.withColumn("reference_numbers", F.array_distinct(F.transform(own, lambda c: c["number"]))).withColumn("content", strip_citations(F.col("sentence"))).where(F.col("content") != "")
    w = Window.partitionBy("query_id").orderBy("rank", "n")
    return s.select("query_id", F.concat(F.lit("E"), F.row_number().over(w)).alias("id"), "content", "source", "page_number", "reference_numbers")


def render(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers (query_id, answer) with ``rendered``: groups like [E1, E2] become citations.

    A group with any unknown id stays. References are preferred to the page; repeated citations of a
    group count once, and in runs with white space between also regardless of letter case, the first
    spelling staying. Citations name a .pdf, in any case of letters.
    """
    pages = F.concat(F.lit("["), F.col("source"), F.lit(", page "), F.col("page_number"), F.lit("]"))
    refs = F.transform("reference_numbers", lambda n: F.concat(F.lit("["), F.col("source"), F.lit(", ref "), n, F.lit("]")))
    e = evidence.select("query_id", "id", F.when(F.size(F.coalesce("reference_numbers", F.array())) > 0, refs).otherwise(F.array(pages)).alias("cites"))
    # The evidence of one query is what one answer was given: a short list.
    known = e.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "cites"))).alias("known"))
    a = answers.join(known, "query_id", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,array<string>>")))

    def group(m: Column) -> Column:
        ids = F.regexp_extract_all(m, F.lit(r"E\d+"), F.lit(0))
        ok = F.forall(ids, lambda i: F.map_contains_key(F.col("known"), i))
        return F.when(ok, F.array_join(F.array_distinct(F.flatten(F.transform(ids, lambda i: F.element_at(F.col("known"), i)))), " ")).otherwise(m)

    def run(m: Column) -> Column:
        cites = F.regexp_extract_all(m, F.lit(RENDERED), F.lit(0))
        low = F.transform(cites, F.lower)
        return F.array_join(F.filter(cites, lambda c, i: F.array_position(low, F.lower(c)) == i + 1), " ")

    text = replace_matches(F.col("answer"), GROUP, group)
    return a.withColumn("rendered", text).withColumn("rendered", replace_matches(F.col("rendered"), f"{RENDERED}(?:\\s+{RENDERED[5:]})+", run)).drop("known")


def final_bibliography(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """query_id, pos, source, number, content of the references cited in ``rendered``, in order of first
    citation; missing ones are left out."""
    c = answers.select("query_id", F.posexplode(cited(F.col("rendered"))).alias("pos", "c")).select("query_id", "pos", "c.source", "c.number")
    return c.join(refs.select("source", "number", "content"), ["source", "number"]).select("query_id", "pos", "source", "number", "content")


#: What the model is told; in words of our own.
RULES = """Answer the question from the evidence below and from nothing else.
- Put the id of the evidence behind every claim it supports, like [E1]. One id stands in each pair of brackets: [E1] [E2], never [E1, E2].
- Cite only ids that are listed, and only where that evidence states the claim itself. Evidence on the same topic is no support.
- Write one sentence for each piece of evidence where you can; a sentence that joins several cites each of them.
- Add no numbers, causes, examples, uses or conclusions that the evidence doesn't state, and don't merge unrelated evidence into a wider claim.
- If the evidence doesn't answer the question, or answers it in part, say so."""


def prompts(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, prompt: rules, question and the evidence, each with its id on a line before it."""
    e = evidence.select("query_id", F.struct(F.expr("int(substring(id, 2))").alias("n"), F.concat_ws("\n", "id", "content").alias("t")).alias("e"))
    e = e.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["t"]), "\n\n---\n\n").alias("list"))
    return questions.join(e, "query_id").select("query_id", F.concat(F.lit(RULES + "\n\nQuestion: "), F.col("text"), F.lit("\n\nEvidence:\n"), F.col("list")).alias("prompt"))
