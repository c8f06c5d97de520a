"""One form for texts that look alike: a compiled longest-match transducer over grapheme clusters.

The mapping is precomputed from a few rules (below) and checked for conflicts when compiled:
every output must be a fixed point, and no two characters that a rule keeps apart may meet.
At run time one compiled pattern walks over a text once; each match is the longest grapheme
cluster that the mapping knows (a base with its combining marks, or a single character).

Equal on the page are: full- and half-width letters and digits, spaces of any width, characters
without width, ligatures, canonically equivalent accents, and look-alike letters of Latin, Greek and
Cyrillic. Letter case, accents, line breaks and punctuation stay apart.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import staged

# Letters of Cyrillic and Greek whose printed shape is that of a Latin letter.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYGQWaesijopcyxhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳν"
GREEK_AS = "ABEZHIKMNOPTYXocjv"
# Characters that print like another one and have no canonical decomposition to it.
SINGLE = {"µ": "μ", "‐": "-", "‑": "-", "ı̇": "i", "ɩ": "ι"}


def rules() -> dict[str, str]:
    """The mapping of single characters, before closure."""
    m = dict(zip(CYRILLIC, CYRILLIC_AS, strict=True)) | dict(zip(GREEK, GREEK_AS, strict=True)) | SINGLE
    for o in range(0xA0, sys.maxunicode + 1):
        c = chr(o)
        cat = unicodedata.category(c)
        if cat == "Zs":
            m[c] = " "
        elif cat == "Cf" and not unicodedata.bidirectional(c) in ("AN",):
            m[c] = ""
        else:
            kind = unicodedata.decomposition(c).split(" ")[0]
            if kind in ("<wide>", "<narrow>") and cat[0] in "LNM":
                m[c] = unicodedata.normalize("NFKC", c)
            elif 0xFB00 <= o <= 0xFB06:
                m[c] = unicodedata.normalize("NFKC", c)
            elif kind and not kind.startswith("<") and unicodedata.normalize("NFC", c) != c:
                m[c] = unicodedata.normalize("NFC", c)  # e.g. the ohm, kelvin and angstrom signs
    for o in [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]:
        m[chr(o)] = ""  # variation selectors
    return m


class Transducer:
    """A compiled mapping; ``apply`` brings a text to its one form in one pass."""

    def __init__(self, single: dict[str, str]) -> None:
        fold = {k: unicodedata.normalize("NFC", "".join(single.get(c, c) for c in v)) for k, v in single.items()}
        for k, v in fold.items():
            if any(fold.get(c, c) != c for c in v):
                raise ValueError(f"the form of {k!a} is not final: {v!a}")
            if k.isalpha() and len(v) == 1 and v.isalpha() and (k.isupper() and v.islower() or k.islower() and v.isupper()):
                raise ValueError(f"{k!a} would change its case")
            if k.isdigit() != v.isdigit() and v.strip() and (k.isdigit() or v.isdigit()):
                raise ValueError(f"{k!a} would become a digit, or cease to be one")
        # What a reader tells apart stays as it is: ASCII, and the letters of Latin with their accents.
        for o in [*range(0x21, 0x7F), *(o for o in range(0xC0, 0x250) if unicodedata.category(chr(o))[0] == "L" and unicodedata.normalize("NFC", chr(o)) == chr(o))]:
            if fold.get(chr(o), chr(o)) != chr(o):
                raise ValueError(f"{chr(o)!a} would become {fold[chr(o)]!a}")
        self.single = fold
        self.clusters: dict[str, str] = dict(fold)
        # Precomposed letters whose base has a look-alike: the accent stays, the base changes.
        for o in range(0xC0, 0x2000):
            c = chr(o)
            d = unicodedata.normalize("NFD", c)
            if len(d) > 1 and d[0] in fold:
                self.clusters[c] = unicodedata.normalize("NFC", fold[d[0]] + d[1:])
        marks = "".join(chr(o) for o in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(o)) == "Mn" and unicodedata.combining(chr(o)) in (202, 214, 216, 220, 230, 232, 233, 234, 240) and not 0x590 <= o <= 0x1ABF)
        marks = "[" + "".join(map(re.escape, marks)) + "]"
        gone = "[" + "".join(re.escape(k) for k, v in fold.items() if v == "" and len(k) == 1) + "]"
        known = sorted((k for k in self.clusters if len(k) > 1), key=len, reverse=True)
        one = "[" + "".join(re.escape(k) for k in self.clusters if len(k) == 1) + "]"
        # Longest first: a base with marks (characters without width may stand between), then known ones.
        # Soft hyphens at the end of a line are printed there.
        self.pattern = re.compile(f"\xad(?=\n)|[^\\s_](?:{gone}*{marks})+|" + "".join(f"{re.escape(k)}|" for k in known) + one)
        # Where a text has no cluster of several characters, the longest match is a single one everywhere.
        self.long = re.compile(f"\xad(?=\n)|{marks}").search
        self.table = str.maketrans({k: v for k, v in self.clusters.items() if len(k) == 1})

    def apply(self, text: str) -> str:
        if text.isascii():
            return text
        if self.long(text):
            return self.pattern.sub(self._cluster, text)
        return text.translate(self.table)

    def _cluster(self, m: re.Match[str]) -> str:
        s = m[0]
        out = self.clusters.get(s)
        if out is None or s == "­":
            out = "-" if s == "­" and m.string[m.end() : m.end() + 1] == "\n" else self._compose(s)
        return out

    @lru_cache(maxsize=1 << 14)  # noqa: B019  one transducer lives as long as its process
    def _compose(self, s: str) -> str:
        d = "".join(self.single.get(c, c) for c in unicodedata.normalize("NFD", s))
        return unicodedata.normalize("NFC", "".join(self.single.get(c, c) for c in unicodedata.normalize("NFD", d)))


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer(rules())


def one_form(text: str | None) -> str | None:
    return None if text is None else transducer().apply(text)


def canonical_text(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """``df`` with the one form of ``column``; null stays null, an empty text empty.

    A text that already is ASCII is its own form and doesn't leave the JVM's columns.
    """

    @F.pandas_udf(T.StringType())
    def fold(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer()
        for s in it:
            yield s.map(lambda x: None if x is None else t.apply(x))

    return df.withColumn(out, F.when(F.col(column).rlike(r"[^\x00-\x7f]"), fold(F.col(column))).otherwise(F.col(column)))


def visual_keys(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, key, variant): hashes of the one form and of the text itself; empty texts left out.

    Only hashes leave the scan, so the exchange behind it is a few bytes a record.
    """

    def keys(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer()
        for b in it:
            # Whether two texts are the same one is decided on 128 bits of each.
            h = [(hashlib.blake2b(t.apply(x).encode("utf-8", "surrogatepass"), digest_size=16).digest(), hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()) for x in b["text"]]
            yield pd.DataFrame({"id": b["id"], "key": [a for a, _ in h], "variant": [c for _, c in h]})

    some = df.select(F.col(id_column).alias("id"), F.col(column).alias("text")).where(F.col("id").isNotNull() & (F.length("text") > 0))
    return some.mapInPandas(keys, "id bigint, key binary, variant binary")


#: Records of a text that are given in pairs with all records of the texts that look like it.
COPIES = 8


def _classes(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(members: tbl, key, variant, id of the keys with several texts; texts: tbl, key, variant, n, reps: the COPIES
    smallest ids). Ids are taken together in two steps, so a text that a third of all rows repeat is never collected."""
    keyed = None
    for name, df in tables.items():
        one = df.withColumn("tbl", F.lit(name))
        keyed = one if keyed is None else keyed.unionByName(one)
    assert keyed is not None
    keyed = keyed.groupBy("tbl", "id").agg(F.first(F.struct("key", "variant")).alias("k")).select("tbl", "id", "k.key", "k.variant")
    part = keyed.groupBy("tbl", "key", "variant", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list("id")), 1, COPIES).alias("r"))
    texts = part.groupBy("tbl", "key", "variant").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("r"))), 1, COPIES).alias("reps"))
    several = texts.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    few = staged(texts.join(several.select("tbl", "key"), ["tbl", "key"]))
    return keyed.join(several.select("tbl", "key"), ["tbl", "key"], "left_semi"), few


def visual_twins(tables: dict[str, DataFrame]) -> DataFrame:
    """Pairs of records of one table that look alike but differ in code points.

    ``tables``: name -> keys as ``visual_keys`` gives them. Result: tbl, id_a < id_b.
    A redelivered record counts once. Null or empty texts never match; equal texts are no pair. Each record is paired
    with the first ``COPIES`` records of each other text of its look, so that the pairs grow with the
    records; of two texts with more records each, pairs of records behind the first ones aren't given
    singly (``visual_classes`` has all records). Every two different texts of one look are paired.
    """
    members, texts = _classes(tables)
    # Members of one look are spread by a salt; its few texts are copied to each.
    spread = texts.select("tbl", "key", F.col("variant").alias("other"), "reps", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    pairs = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(spread, ["tbl", "key", "salt"]).where("variant <> other")
    pairs = pairs.select("tbl", "id", F.explode("reps").alias("twin"))
    return pairs.select("tbl", F.least("id", "twin").alias("id_a"), F.greatest("id", "twin").alias("id_b")).distinct()


def visual_classes(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each record whose look several texts have: tbl, id, class_id (smallest id of that look), text_id
    (smallest id of that very text), n_texts, n_records of the look."""
    members, texts = _classes(tables)
    looks = texts.groupBy("tbl", "key").agg(F.min(F.col("reps")[0]).alias("class_id"), F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_records"))
    m = members.join(texts.select("tbl", "key", "variant", F.col("reps")[0].alias("text_id")), ["tbl", "key", "variant"]).join(looks, ["tbl", "key"])
    return m.select("tbl", "id", "class_id", "text_id", "n_texts", "n_records")
