"""Noise in text from scanned pages: broken words, misread characters, running lines, page numbers.

Words are grouped by a confusable-glyph skeleton: every character or pair that scanners take for
another is spelled out in the same strokes, so a word and its misreadings share a skeleton. In a
group the frequent form stands for the word; a rare form is a misreading. Corpus counts are over
all unbroken words of all records. Running lines are found by masking digits and counting
pages. What opens the next line of running text is found by running values along the source, taken
in two steps so that no source is one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.running_lines import at_edge, repeated_line_blocks
from marginalia.llm.visual import transducer
from marginalia.operators.running import running
from marginalia.session import staged

# What a scanner reads for a character, as (character, misread as).
CONFUSIONS = [
    ("e", "c"), ("t", "f"), ("n", "ri"), ("s", "5"), ("o", "0"), ("l", "1"), ("g", "9"), ("u", "ii"),
    ("m", "rn"), ("d", "cl"), ("h", "li"), ("b", "6"), ("i", "!"), ("w", "vv"),
]
#: Marks put at the end of a line for a break.
MARKS = "-‐‑¬­"
#: A form is a misreading if its word is at least so many times as frequent.
RATIO = 12
#: Misread forms looked up in memory; more are joined.
LOOKUP_FORMS = 1_000_000

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_word = re.compile(f"!?[{_LATIN}0-9]+(?:!+[{_LATIN}0-9]+)*")
_letter = re.compile(f"[{_LATIN}]")
_tail = re.compile(f"([{_LATIN}0-9!]*[{_LATIN}0-9])[{MARKS}]\\s*$")
_head = re.compile(f"\\s*([{_LATIN}0-9!]*[{_LATIN}0-9])")
# The mark first: a pattern that begins with few characters is looked for fast.
_break = re.compile(f"[{MARKS}](?<=[^\\W\\d_].)[ \t]*\n")
_next = re.compile(r"\s*\S*")
_compound = re.compile(f"(?=\\b([{_LATIN}]+)-([{_LATIN}]+))")
_digits = re.compile("[0-9]+")
_number = re.compile(r"(?i)\W*(?:(?:page|pg|p|seite|página|стр|σελ|第|หน้า)\b\W*|)(?:(\d{1,9})|([ivxlcdm]+))\W*(?:(?:of|von|de|sur|из)\W+\d+\W*)?")

_SPELLED: dict[str, str] = {}
for _c, _as in CONFUSIONS:
    _SPELLED[_c if len(_as) > 1 else _as] = _as if len(_as) > 1 else _c
_SPELLED["m"] = "rri"  # its reading as r and n, the n spelled out too
_SPELL = str.maketrans(_SPELLED | {"f": "t", "c": "e", "d": "el"})


def skeleton(word: str) -> str:
    """The strokes of a lower-cased word."""
    return word.translate(_SPELL)


def roman(n: int) -> str:
    out = ""
    for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + s * (n // v), n % v
    return out


def is_page_number(line: str, page: int | None) -> bool:
    """Whether the line is nothing but the number of its page, in Arabic or Roman digits."""
    m = _number.fullmatch(line.strip())
    if page is None or not m:
        return False
    return int(m[1]) == page if m[1] else 0 < page < 4000 and m[2].lower() == roman(page)


def _shape(word: str) -> bool:
    """Whether a token may be a word: letters, few other signs, no code in capitals with digits."""
    letters = len(_letter.findall(word))
    other = len(word) - letters
    return letters >= 2 and other <= max(1, letters // 2) and not (other and word.upper() == word)


def _lines(text: str) -> tuple[list[str], list[str]]:
    """Lines as they are, and in the one form of look-alike characters."""
    raw = text.split("\n")
    folded = transducer().apply(text).split("\n")
    return raw, folded if len(folded) == len(raw) else [transducer().apply(x) for x in raw]


def _words_of(raw: list[str], lines: list[str]) -> Iterator[tuple[int, list[str], str | None]]:
    """(line, unbroken words, broken word's first part) of each line that isn't blank; the second
    part of a broken word isn't among the words of its line."""
    broken = False
    for i, line in enumerate(lines):
        if not line or line.isspace():
            continue
        words = _word.findall(line)
        if broken and words and _head.match(line):
            words = words[1:]
        broken = False
        part = None
        last = raw[i].rstrip()[-1:]
        if last and last in MARKS and (m := _tail.search(raw[i].rstrip()[:-1] + "-")) and words:
            part = transducer().apply(m[1])
            words, broken = words[:-1], True
        yield i, words, part


def _line_words(raw: list[str], at: list[int]) -> Iterator[tuple[int, list[str]]]:
    """(line, unbroken words) as ``_words_of`` has them, of the lines ``at`` only: what is before the last line that
    surely ends without a break says nothing about a line."""
    if len(at) > 8:
        some = set(at)
        yield from ((i, words) for i, words, _ in _words_of(*_lines("\n".join(raw))) if i in some)
        return
    for i in at:
        a = i
        while a and not ((c := raw[a - 1].rstrip()[-1:]) and c not in MARKS and (c.isascii() or c.isalnum())):
            a -= 1
        # The line behind it settles what its end is.
        for k, words, _ in _words_of(*_lines("\n".join(raw[a : i + 1] + raw[i + 1 : i + 2]))):
            if a + k == i:
                yield i, words


def _first_word(line: str) -> str | None:
    """The word that a line opens with, in the one form; only its first stretch between white space is brought to it,
    if anything of that can be seen."""
    fold = transducer().apply
    start = fold(_next.match(line)[0])
    head = _head.match(start if start and not start.isspace() else fold(line))
    return head[1] if head else None


def _last_part(line: str) -> str | None:
    """The part of a word before the mark that a line without white space behind it ends in, in the one form."""
    m = _tail.search(transducer().apply(line[:-1].rsplit(None, 1)[-1] if line[-2:-1].strip() else "") + "-")
    return m[1] if m else None


def _unbroken(text: str) -> str:
    """The text with a space for the broken words: stretches that end in a mark at the end of a line with
    the next one."""
    m = _break.search(text)
    if m is None:
        return text
    out, last = [], 0
    while m:
        a = m.start()
        while a > last and not text[a - 1].isspace():
            a -= 1
        out.append(text[last:a])
        last = _next.match(text, m.end()).end()
        m = _break.search(text, last)
    return " ".join([*out, text[last:]])


def word_counts(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """form, n over all unbroken words (lower-cased) and their hyphenated pairs; counted per task first."""

    def tokens(count: Counter[str]) -> pd.DataFrame:
        """The counted stretches between white space, each distinct one taken apart once."""
        out: Counter[str] = Counter()
        fold = transducer().apply
        for raw, n in count.items():
            w = fold(raw)
            for t in _word.findall(w):
                out[t] += n
            if "-" in w:
                for x, y in _compound.findall(w):
                    out[f"{x}-{y}"] += n
        count.clear()
        return pd.DataFrame({"form": list(out), "n": list(out.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter[str] = Counter()
        for b in batches:
            for text in b["content"]:
                count.update(_unbroken(text).split())
            if len(count) > flush:
                yield tokens(count)
        if count:
            yield tokens(count)

    c = texts.where(F.col("content").isNotNull()).select("content").mapInPandas(run, "form string, n bigint")
    return c.where(F.col("form").rlike(f"[{_LATIN}]{{2}}|[{_LATIN}].*[{_LATIN}]")).groupBy(F.lower("form").alias("form")).agg(F.sum("n").alias("n"), F.max(F.col("form") != F.upper("form")).alias("mixed"))


def _skeleton_udf():  # noqa: ANN202
    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(skeleton)

    return of


def misread_forms(counts: DataFrame) -> DataFrame:
    """form, word: rare forms with the frequent word of the same skeleton.

    A form with digits or marks between letters needs a word of letters only that is at least as
    frequent; one of letters only needs a word ``RATIO`` times as frequent. Of several words
    the most frequent is meant, of equally frequent ones the first in order.
    """
    w = counts.where(~F.col("form").contains("-") & (F.length("form") >= 3)).withColumn("skeleton", _skeleton_udf()("form"))
    w = w.withColumn("pure", F.col("form").rlike(f"^[{_LATIN}]+$")).where(F.col("pure") | F.col("mixed"))
    best = w.where("pure").groupBy("skeleton").agg(F.max_by(F.struct("form", "n"), F.struct(F.col("n"), F.col("form"))).alias("best"), F.count(F.lit(1)).alias("forms"))
    m = w.join(best, "skeleton").where(F.col("form") != F.col("best.form"))
    rare = F.when(F.col("pure"), (F.col("best.n") >= RATIO * F.col("n")) & (F.length("form") >= 4)).otherwise(F.col("best.n") >= F.greatest(F.lit(2), F.col("n")))
    return m.where(rare).select("form", F.col("best.form").alias("word"))


_FOUND = "what string, row_id bigint, source string, page_number int, pos int, line_no int, a string, b string, mark string, header string, next_no int"


def _read_lines(texts: DataFrame, forms: Broadcast | None, edges: int) -> DataFrame:
    """What one pass over the records tells about their lines, as rows of ``_FOUND``:

    ``misread`` (line_no), or without ``forms`` ``token`` (line_no, a): every word, for a join;
    ``broken`` (line_no, a, b, mark, next_no): a word's parts on consecutive lines;
    ``edge``: for windows along the source, the first and last lines of the record, with the part
    they end in (a, mark), the word they open with in lower case (b), their masked text
    (header) and, in ``mark`` = "#", whether they are the page's number.
    """

    class Misread(dict):
        """Whether a stretch between white space holds a misread form."""

        def __init__(self, known: object) -> None:
            super().__init__()
            self.known, self.fold = known, transducer().apply

        def __missing__(self, raw: str) -> bool:
            if len(self) > 1 << 19:
                self.clear()
            out = self[raw] = not self.known.isdisjoint(_word.findall(raw.lower()) if raw.isascii() else [t.lower() for t in _word.findall(self.fold(raw))])
            return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = forms.value.keys() if forms else frozenset()
        misread = Misread(known)
        for batch in batches:
            out = []
            for key, source, page, pos, text in batch[["row_id", "source", "page_number", "pos", "content"]].itertuples(index=False):
                page = None if page is None or page != page else int(page)
                where = (key, source, page, pos)
                raw = text.split("\n")
                if forms is None:
                    for i, words, _ in _words_of(*_lines(text)):
                        out += [("token", *where, i + 1, w, None, None, None, 0) for w in {x.lower() for x in words}]
                elif ill := [x for x in set(text.split()) if misread[x]]:
                    for i, words in _line_words(raw, [i for i, x in enumerate(raw) if not set(ill).isdisjoint(x.split())]):
                        if not known.isdisjoint([x.lower() for x in words]):
                            out.append(("misread", *where, i + 1, None, None, None, None, 0))
                full = [i for i, x in enumerate(raw) if x and not x.isspace()]
                if not full:
                    continue
                keep = edges + 1 if edges else 1
                late = len(full) - keep
                near = full if len(full) <= 2 * keep else full[:keep] + full[-keep:]
                parts = {}
                if _break.search(text + "\n"):
                    for k, i in enumerate(full):
                        line = raw[i].rstrip()
                        if line[-1] in MARKS and (part := _last_part(line)):
                            if k < late:
                                out.append(("broken", *where, i + 1, part, _first_word(raw[full[k + 1]]) or "", line[-1], None, full[k + 1] + 1))
                            else:
                                parts[i] = part
                seq = {i: k for k, i in enumerate(full)}
                for i in near:
                    k = seq[i]
                    line = raw[i]
                    head = _first_word(line) if line.lstrip()[:1].islower() else None
                    at_edge = k < max(1, edges) or k >= len(full) - max(1, edges)
                    number = at_edge and len(line) < 48 and is_page_number(line, page)
                    last = parts.get(i)
                    if edges or number or last or head:
                        out.append(("number" if number else "edge", *where, i + 1, last, head if not number else None, line.rstrip()[-1] if last else None, _digits.sub("\x01", line.lower()) if edges and at_edge else None, 0))
            yield pd.DataFrame(out, columns=["what", "row_id", "source", "page_number", "pos", "line_no", "a", "b", "mark", "header", "next_no"])

    return texts.where(F.col("row_id").isNotNull() & F.col("content").isNotNull()).mapInPandas(run, _FOUND)


def _headers(lines: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """row_id, line_no of running lines: masked lines at the edge of enough of a source's pages."""
    pages = lines.where(F.col("source").isNotNull()).select("source", "page_number").distinct().groupBy("source").agg(F.count("page_number").alias("pages"))
    on = lines.where(F.col("source").isNotNull() & F.col("header").isNotNull()).select("source", "header", "page_number").distinct().groupBy("source", "header").agg(F.count("page_number").alias("n"))
    often = on.join(pages, "source").where((F.col("n") >= min_pages) & (F.col("n") >= min_share * F.col("pages") - 1e-9)).select("source", "header")
    return lines.where("what = 'edge' AND header IS NOT NULL").join(often, ["source", "header"], "left_semi").select("row_id", "line_no")


def _across(lines: DataFrame) -> DataFrame:
    """Broken words at the end of records with the word in lower case that opens the next line of
    running text, however far it is: row_id, line_no, a, b, mark, next_row, next_no. Nothing follows where the
    source or the page is unknown."""
    placed = F.col("source").isNotNull() & F.col("page_number").isNotNull()
    back = {"_p": -F.col("page_number"), "_o": -F.col("pos"), "_l": -F.col("line_no"), "_r": -F.col("row_id")}
    opens = F.when(placed & F.col("b").isNotNull(), F.struct("b", "row_id", "line_no"))
    found = running(lines.where("a IS NOT NULL OR b IS NOT NULL").withColumns(back), {"next": ("last", opens)}, tuple(back), inclusive=False)
    found = found.where("a IS NOT NULL").withColumn("next", F.when(placed, F.col("next")))
    return found.select("row_id", "line_no", "a", F.coalesce("next.b", F.lit("")).alias("b"), "mark", F.col("next.row_id").alias("next_row"), F.col("next.line_no").alias("next_no"))


def _known_words(counts: DataFrame) -> DataFrame:
    """k, v, n: the counts of words (k = "w") and of skeletons ("s")."""
    return counts.select(F.lit("w").alias("k"), F.col("form").alias("v"), "n").unionByName(counts.groupBy(_skeleton_udf()("form").alias("v")).agg(F.sum("n").alias("n")).select(F.lit("s").alias("k"), "v", "n"))


def _hyphen_lines(broken: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``broken`` (tbl, row_id, line_no, a, b, mark) that are broken words, not compounds
    that keep their hyphen. ``known`` is what ``_known_words`` gives.

    The signs for breaks only settle it. Else the whole word and the compound are looked up among
    the unbroken words, then their skeletons (a part may be misread); where neither is known, two
    parts that are words themselves, or a second part with a capital, are a compound.
    """
    b = broken.withColumn("joined", F.lower(F.concat("a", "b"))).withColumn("kept", F.lower(F.concat_ws("-", "a", "b")))
    b = staged(b.withColumn("sj", _skeleton_udf()("joined")).withColumn("sk", _skeleton_udf()("kept")))
    pairs = F.struct
    asked = (
        b.select(F.explode(F.array(*[pairs(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (("w", "joined"), ("w", "kept"), ("s", "sj"), ("s", "sk"))], pairs(F.lit("w").alias("k"), F.lower("a").alias("v")), pairs(F.lit("w").alias("k"), F.lower("b").alias("v")))).alias("q"))
        .select("q.k", "q.v")
        .distinct()
    )
    # Looked up six times below.
    answer = staged(asked.join(known, ["k", "v"]))
    for k, c, out in (("w", "joined", "nj"), ("w", "kept", "nk"), ("s", "sj", "nsj"), ("s", "sk", "nsk"), ("w", "la", "na"), ("w", "lb", "nb")):
        if c in ("la", "lb"):
            b = b.withColumn(c, F.lower(c[1]))
        b = b.join(answer.where(F.col("k") == k).select(F.col("v").alias(c), F.col("n").alias(out)), c, "left").fillna({out: 0})
    letters = F.col("a").rlike(f"[{_LATIN}]")
    word = F.when(F.col("mark").isin("¬", "­"), True)
    word = word.when(F.col("b") == "", ~(F.col("na") >= 5)).when(~F.col("b").rlike(f"^[{_LATIN}!0-9]*[{_LATIN}]"), False)
    word = word.when(F.col("nj") + F.col("nk") > 0, F.col("nj") >= F.col("nk")).when(F.col("nsj") + F.col("nsk") > 0, F.col("nsj") >= F.col("nsk"))
    word = word.otherwise(F.col("b").rlike("^[^A-ZÀ-Þ]") & ~((F.col("na") >= 5) & (F.col("nb") >= 5)))
    return b.where(letters & word).select(*broken.columns)


def noisy_lines(pages: DataFrame, blocks: DataFrame, *, min_pages: int = 3, min_share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(found, forms): found has tbl, row_id, line_no, kind; forms the misread forms with their words.

    ``pages``: row_id, source, page_number, content; ``blocks`` also pos (their order on the page).
    Records count once. Null ids and contents have no lines; a null source or page has no running
    lines and nothing follows its last line. Lines are counted from 1, blank ones included.
    """
    spark = pages.sparkSession
    p = pages.select("row_id", "source", "page_number", F.lit(0).alias("pos"), "content")
    b = blocks.select("row_id", "source", "page_number", "pos", "content")
    counts = staged(word_counts(p.select("content").unionByName(b.select("content"))))
    forms, known = staged(misread_forms(counts)), staged(_known_words(counts))
    few = forms.count() <= LOOKUP_FORMS
    lookup = spark.sparkContext.broadcast(dict(forms.collect())) if few else None
    found = None
    for name, df, edges in (("doc_pages", p, 3), ("blocks", b, 0)):
        lines = staged(_read_lines(df, lookup, edges).distinct())
        out = lines.where("what = 'misread'").select("row_id", "line_no")
        if not few:
            out = lines.where("what = 'token'").select("row_id", "line_no", F.col("a").alias("form")).join(forms, "form", "left_semi").select("row_id", "line_no")
        out = out.withColumn("kind", F.lit("misread"))
        running = lines.where("what IN ('edge', 'number')")
        text = running.where("what = 'edge'")
        if edges:
            headers = staged(_headers(running, min_pages, min_share))
            out = out.unionByName(headers.withColumn("kind", F.lit("header"))).unionByName(lines.where("what = 'number'").select("row_id", "line_no", F.lit("page_no").alias("kind")))
            text = text.join(headers, ["row_id", "line_no"], "left_anti")
        across = _across(text.select("row_id", "source", "page_number", "pos", "line_no", "a", "b", "mark"))
        inside = lines.where("what = 'broken'").select("row_id", "line_no", "a", "b", "mark", F.col("row_id").alias("next_row"), "next_no")
        hyphens = staged(_hyphen_lines(inside.unionByName(across), known))
        # A misread broken word: the line that has the misread characters.
        split = hyphens.withColumn("form", F.lower(F.concat("a", "b"))).join(forms, "form")
        first = F.expr("substr(word, 1, length(a))") != F.lower("a")
        split = split.select(F.when(first, F.col("row_id")).otherwise(F.col("next_row")).alias("row_id"), F.when(first, F.col("line_no")).otherwise(F.col("next_no")).alias("line_no"), F.lit("misread").alias("kind"))
        out = out.unionByName(hyphens.select("row_id", "line_no", F.lit("hyphen").alias("kind"))).unionByName(split.where("row_id IS NOT NULL"))
        out = out.distinct().select(F.lit(name).alias("tbl"), "row_id", "line_no", "kind")
        found = out if found is None else found.unionByName(out)
    return found, forms


def _repaired(texts: DataFrame, found: DataFrame, forms: DataFrame) -> DataFrame:
    """Paragraphs within the records of one table: source, page_number, pos, row_id, para, text, joined (ends
    inside a broken word), open (ends without a final mark), lower (opens in lower case).

    ``texts``: row_id, source, page_number, pos, content, each record once; ``found``: their noisy lines.
    """
    spark = texts.sparkSession
    marks = found.groupBy("row_id").agg(F.collect_set(F.struct("line_no", "kind")).alias("marks"))
    # The misread forms are looked up in memory, or beyond the limit each paragraph gets its own ones by a join.
    few = forms.count() <= LOOKUP_FORMS
    shared = spark.sparkContext.broadcast(dict(forms.collect())) if few else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = transducer().apply
        for b in batches:
            out = []
            for source, page, pos, key, text, marks in b[["source", "page_number", "pos", "row_id", "content", "marks"]].itertuples(index=False):
                kinds: dict[int, set[str]] = {}
                for m in marks if marks is not None else ():
                    kinds.setdefault(m["line_no"], set()).add(m["kind"])
                paras: list[str] = [""]
                # Paragraphs that may hold misread forms: by their lines, or in words over two lines.
                mending: set[int] = set()
                glue = False
                for i, line in enumerate(text.split("\n"), 1):
                    k = kinds.get(i, ())
                    if "header" in k or "page_no" in k:
                        continue
                    line = fold(line).strip()
                    if not line:
                        if not glue and paras[-1]:
                            paras.append("")
                        continue
                    paras[-1] += ("" if glue or not paras[-1] else " ") + line
                    # A broken word loses the mark; a compound or a range keeps its hyphen, without a space.
                    marked = paras[-1][-1] in MARKS and paras[-1][-2:-1].isalnum()
                    glue = marked
                    if marked or "misread" in k:
                        mending.add(len(paras) - 1)
                    if marked and "hyphen" in k:
                        paras[-1] = paras[-1][:-1]
                kept = [(p, n in mending) for n, p in enumerate(paras) if p]
                for n, (p, ill) in enumerate(kept):
                    p = _mended(p, shared.value) if ill and few else p
                    cut = glue and n == len(kept) - 1
                    out.append((source, page, pos, key, n, p, cut, cut or p[-1] not in ".!?。！？।؟:;\"”»)", p[:1].islower(), ill))
            yield pd.DataFrame(out, columns=["source", "page_number", "pos", "row_id", "para", "text", "joined", "open", "lower", "ill"])

    some = texts.where(F.col("row_id").isNotNull() & F.col("content").isNotNull()).join(marks, "row_id", "left")
    done = some.mapInPandas(run, "source string, page_number int, pos int, row_id bigint, para int, text string, joined boolean, open boolean, lower boolean, ill boolean")
    return done.drop("ill") if few else _mended_by_join(staged(done), forms)


def _mended(text: str, known: dict[str, str]) -> str:
    def one(m: re.Match[str]) -> str:
        w = known.get(m[0].lower())
        return m[0] if w is None else w.capitalize() if m[0][0].isupper() else w

    return _word.sub(one, text)


def _mended_by_join(done: DataFrame, forms: DataFrame) -> DataFrame:
    """The paragraphs with those marked ``ill`` mended by the forms that they hold."""

    @F.pandas_udf("array<string>")
    def words(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sorted({x.lower() for x in _word.findall(t)}))

    @F.pandas_udf("string")
    def mend(s: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([t if m is None else _mended(t, dict(m)) for t, m in zip(s, right, strict=True)])

    own = done.where("ill").select("row_id", "para", F.explode(words("text")).alias("form")).join(forms, "form")
    own = own.groupBy("row_id", "para").agg(F.map_from_entries(F.collect_list(F.struct("form", "word"))).alias("right"))
    j = done.join(own, ["row_id", "para"], "left")
    return j.withColumn("text", F.when(F.col("right").isNotNull(), mend("text", "right")).otherwise(F.col("text"))).select(*[c for c in done.columns if c != "ill"])


def _continuous(repaired: DataFrame) -> DataFrame:
    """Paragraphs of ``_repaired`` put together over records in the order page_number, pos, row_id: source,
    page_number, row_id, para (where it starts), n_parts, content.

    One that ends openly at the end of a record goes on with a first paragraph of the next record that
    opens in lower case. What the record before ends with, and where a paragraph started, are running
    values in two steps. Nothing goes on from a null source or page.
    """
    p = staged(repaired)
    placed = F.col("source").isNotNull() & F.col("page_number").isNotNull()
    last = p.groupBy("source", "page_number", "pos", "row_id").agg(F.max_by(F.struct("open", "joined"), F.col("para")).alias("end"))
    ends = running(last, {"before": ("last", F.when(placed, F.col("end")))}, ("page_number", "pos", "row_id"), inclusive=False).select("row_id", "before")
    p = p.join(ends, "row_id").withColumn("goes_on", placed & (F.col("para") == 0) & F.coalesce(F.col("before.open") & F.col("lower"), F.lit(False)))
    at = F.struct("page_number", "pos", "row_id", "para")
    p = running(p, {"first": ("last", F.when(~F.col("goes_on"), at))}, ("page_number", "pos", "row_id", "para"))
    p = p.withColumn("first", F.coalesce("first", at))
    glue = F.when(F.col("goes_on"), F.when(F.col("before.joined"), F.lit("")).otherwise(F.lit(" "))).otherwise(F.lit(""))
    parts = F.array_sort(F.collect_list(F.struct("page_number", "pos", "row_id", "para", F.concat(glue, F.col("text")).alias("t"))))
    g = p.groupBy("source", "first").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("content"), F.count(F.lit(1)).alias("n_parts"))
    return g.select("source", "first.page_number", "first.row_id", "first.para", "n_parts", "content")


def _page_paragraphs(pages: DataFrame, found: DataFrame, forms: DataFrame) -> DataFrame:
    return _continuous(_repaired(pages.withColumn("pos", F.lit(0)), found.where("tbl = 'doc_pages'"), forms))


def paragraphs(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Continuous paragraphs of the pages: source, page_number (where it starts), row_id, para, n_parts, content.

    Running lines and page numbers are left out, broken words joined, misread ones mended, lines reflowed.
    ``pages``: each record once. ``blocks`` only add to the counts of words.
    """
    return _page_paragraphs(pages, *noisy_lines(pages, blocks))


def _running_text(blocks: DataFrame) -> DataFrame:
    """``blocks`` without those that are repeated lines (as in p4) or nothing but their page's number, at
    the page's edge or where y0 is unknown."""
    lines = blocks.select(F.col("row_id").alias("block_id"), "source", "page_number", F.col("pos").alias("block_index"), "content", "y0", "page_height")
    gone = repeated_line_blocks(lines).distinct().withColumnRenamed("block_id", "row_id")

    @F.pandas_udf("boolean")
    def number(content: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([c is not None and len(c) < 48 and is_page_number(c, None if n != n else int(n)) for c, n in zip(content, page.astype(float), strict=True)], dtype=bool)

    edge = F.coalesce(at_edge(F.col("y0"), F.col("page_height")), F.lit(True))
    short = blocks.where(edge & (F.length("content") < 48) & F.col("page_number").isNotNull())
    gone = gone.unionByName(short.where(number("content", "page_number")).select("row_id"))
    return blocks.join(gone, "row_id", "left_anti")


def all_paragraphs(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Continuous paragraphs of both tables: tbl, source, page_number (where it starts), row_id, para, n_parts, content.

    ``pages``: as in ``paragraphs``. ``blocks``: row_id, source, page_number, pos, content, y0, page_height; a block
    is at least one paragraph, blocks of repeated lines and page numbers are left out. Each record once.
    """
    found, forms = noisy_lines(pages, blocks)
    of_blocks = _continuous(_repaired(_running_text(blocks), found.where("tbl = 'blocks'"), forms))
    of_pages = _page_paragraphs(pages, found, forms)
    return of_pages.select(F.lit("doc_pages").alias("tbl"), "*").unionByName(of_blocks.select(F.lit("blocks").alias("tbl"), "*"))
