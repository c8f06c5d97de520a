"""Byte-level BPE of whole texts by prefix dynamic programming.

For every byte prefix of a piece (a pre-token) there is exactly one token that its encoding ends
with. The table of these last tokens is built from left to right: of the tokens that end at a
position, longest first, the last one is the token that may follow the last token of the prefix
before it. Two tokens may follow each other if the merges, applied to their bytes together, give
the two again. Reading the table backwards gives the ids, so appending costs only the new
bytes, and after an edit the table before the edit stays valid.

Pieces never influence each other, so a text is split once by the vocabulary's own pattern and
equal pieces are encoded once per process (a bounded memo: it affects time only).
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Pieces remembered per process; beyond that the memo starts anew.
MEMO = 1 << 19

# White space as the vocabulary's pattern means it (the Unicode property).
WHITE_SPACE = "\t-\r \x85\xa0  -     　"


def _ranges(major: str) -> str:
    """The characters of a major category as the inside of a character class."""
    out, start = [], None
    for o in range(sys.maxunicode + 2):
        inside = o <= sys.maxunicode and unicodedata.category(chr(o))[0] == major
        if inside and start is None:
            start = o
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{o - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def piece_pattern() -> re.Pattern[str]:
    """The split before the merges: contractions, words, numbers, other signs and white space, the
    first three with one space before them; a run of white space leaves its last for what follows."""
    letter, number, space = _ranges("L"), _ranges("N"), WHITE_SPACE
    return re.compile(
        f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+".replace(
            # A contraction comes before any other branch that could take its apostrophe; a word can't.
            f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)", f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+"
        )
    )


class Vocabulary:
    """Tokens by their bytes; the rank is the id and the order of the merges."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {i: t for t, i in self.rank.items()}
        self.longest = max(map(len, self.rank))
        #: Longest token that ends with given two bytes: bounds the search for suffixes.
        self.reach: dict[bytes, int] = {}
        for t in self.rank:
            if len(t) > self.reach.get(t[-2:], 0):
                self.reach[t[-2:]] = len(t)
        self.follows: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges applied in order of rank; the definition, used for pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
            if best == sys.maxsize:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges keep tokens ``a`` and ``b`` apart when they meet."""
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > 1 << 20:
                self.follows.clear()
            known = self.follows[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return known

    @lru_cache(maxsize=1 << 16)  # noqa: B019  one vocabulary lives as long as its process
    def reachable(self, token: int) -> bool:
        """Whether the merges make this token of its own bytes."""
        return self.merged(self.token[token]) == [token]


class PrefixTable:
    """The last token of every prefix of one piece. ``ids`` are those of the whole piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Lengthen the piece; what is known of its prefixes stays."""
        v, rank, last = self.v, self.v.rank, self.last
        start = len(self.data)
        self.data = text = self.data + data
        for end in range(start + 1, len(text) + 1):
            reach = v.reach.get(text[end - 2 : end], 1) if end > 1 else 1
            for size in range(min(end, reach), 0, -1):
                token = rank.get(text[end - size : end])
                if token is None:
                    continue
                before = last[end - size]
                if v.reachable(token) if before < 0 else v.reachable(token) and v.may_follow(before, token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends the prefix {text[:end]!r}")

    def splice(self, start: int, end: int, data: bytes) -> None:
        """Replace bytes start..end; only prefixes that reach beyond ``start`` are computed anew."""
        rest = self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(data + rest)

    @property
    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self.v.token[token])
        return out[::-1]


class _Memo(dict):
    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.v = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        whole = self.v.rank.get(data)
        ids = (whole,) if whole is not None and self.v.reachable(whole) else tuple(PrefixTable(self.v, data).ids)
        if len(self) >= MEMO:
            self.clear()
        self[piece] = ids
        return ids


class _Words(dict):
    """Ids of a word with one space before it; long words aren't kept."""

    def __init__(self, memo: _Memo, split) -> None:  # noqa: ANN001
        super().__init__()
        self.memo, self.split = memo, split

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(chain.from_iterable(map(self.memo.__getitem__, self.split(" " + word))))
        if len(word) <= 48:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts. No piece reaches over a space that something visible follows, so a text where
    every space is such a one is cut there first, and equal words are encoded once."""

    def __init__(self, path: str) -> None:
        self.memo = _Memo(Vocabulary(path))
        self.split = piece_pattern().findall
        self.words = _Words(self.memo, self.split)
        self.odd = re.compile(f" (?:[{WHITE_SPACE}]|\\Z)").search

    def _parts(self, text: str) -> Iterator[tuple[int, ...]]:
        if self.odd(text):
            return map(self.memo.__getitem__, self.split(text))
        head, *words = text.split(" ")
        return chain(map(self.memo.__getitem__, self.split(head)), map(self.words.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        """The ids; of a null or empty text none."""
        return list(chain.from_iterable(self._parts(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self._parts(text))) if text else 0


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> Encoder:
    return Encoder(f"{folder}/{name}")


def encode_table(df: DataFrame, id_column: str, column: str, *, folder: str = TOKENIZERS, rows: int = 256) -> DataFrame:
    """(id, ids array<int>) of every row. Null and empty texts have an empty list; repeated rows
    are encoded as they come. The ids go to Arrow as one buffer for each ``rows`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder=folder)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                each = [e.encode(t) for t in b.column(1).to_pylist()]
                offsets = np.zeros(len(each) + 1, np.int32)
                np.cumsum([len(x) for x in each], out=offsets[1:])
                values = np.fromiter(chain.from_iterable(each), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "ids"])

    return df.select(F.col(id_column).alias("id"), F.col(column).alias("text")).mapInArrow(run, "id bigint, ids array<int>").withColumnRenamed("id", id_column)


def token_counts(df: DataFrame, column: str, out: str = "tokens", *, folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with the number of tokens of ``column``; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def count(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(folder=folder)
        for s in it:
            yield pd.Series([e.count(x) for x in s], dtype="int64")

    return df.withColumn(out, count(F.col(column)))
