"""Sentence boundaries across languages and scripts, by a linear-chain model with Viterbi decoding.

Characters are tagged as boundary or inside. Only characters that can change the tag are
nodes of the chain: final marks (with what closes after them), quotation marks, brackets, and in
Thai, which has no marks, spaces and line breaks; all between them are inside. A node's label is
the state after it: outside, a boundary (outside), in a quotation, in brackets. Weights of
features and of transitions, by the node's type, come from an averaged structured perceptron that is
trained on a labelled table (``sentence_training``) of texts put together of sentences with known
ends; its Thai texts are stripped of all marks. Decoding runs over batches of texts in numpy.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.pii_training import common_words
from marginalia.llm.sentence_training import labelled_texts

Weights = tuple[dict[str, np.ndarray], np.ndarray, frozenset[str]]
OUT, END, QUOTE, PAREN = range(4)
MARK, MARK_QUOTE, MARK_PAREN, OPEN_Q, CLOSE_Q, EITHER_Q, OPEN_P, CLOSE_P, THAI = range(9)

_THAI = "฀-๿"
#: Final marks, those of further scripts among them.
MARKS = ".!?…。！？؟।॥;;።፧፨։۔។៕။᠃᠉‼⁇⁈⁉｡．"
_node = re.compile(
    f"[{MARKS}]+(?:[\u00a0\u202f\u2009 ]?[»]|[\"'”’“)\\]」』）])*(?:\\[[0-9][0-9, –-]*\\])?"
    "|[\"“”„«»‘’「」『』()（）]"
    f"|(?<=[{_THAI}])\\s+(?=\\S)"
)
_before = re.compile(r"[^\W_]*$")
_amount = re.compile(r"\d[ \u00a0\n]?$")
_after = re.compile(r"(\s*)([^\w\s]?)([^\W_]*)")
_script = {**{c: "thai" for c in range(0x0E00, 0x0E80)}}
_opens, _closes = "“„«‘「『", "”»」』"


def _kind(word: str, sign: str) -> str:
    if not word:
        return sign or "end"
    c = word[0]
    if c.isdigit():
        return "0"
    o = ord(c)
    if o >= 0x3000:
        return "cjk"
    if not (c.isupper() or c.islower()):
        return "thai" if 0x0E00 <= o < 0x0E80 else "caseless"
    return (sign if sign and sign in "¿¡«„“\"'(" else "") + ("A" if c.isupper() else "a")


class Nodes:
    """Nodes of a text: (end offset, type, key); keys are interned with their features."""

    def __init__(self, common: frozenset[str]) -> None:
        self.common = common
        self.keys: dict[tuple, int] = {}
        self.features: list[list[str]] = []

    def key(self, k: tuple) -> int:
        i = self.keys.get(k)
        if i is None:
            i = self.keys[k] = len(self.features)
            self.features.append(_features(*k))
        return i

    def of(self, text: str) -> list[tuple[int, int, int]]:
        out = []
        for m in _node.finditer(text):
            s = m[0]
            i, j = m.span()
            c = s[0]
            if c in MARKS:
                prev = _before.search(text, max(0, i - 24), i)[0]
                gap, sign, word = _after.match(text, j, j + 40).groups()
                at = i - len(prev)
                if prev:
                    lead = text[at - 1] if at else ""
                    last = ("." if lead == "." else "") + (prev if len(prev) <= 6 else "Word" if prev[0].isupper() else "word")
                    if prev[-1].isdigit():
                        last = "0"
                    elif len(prev) < 4 and _amount.search(text, max(0, at - 8), at):
                        last = "unit"
                    elif ord(prev[-1]) >= 0x3000:
                        last = "cjk"
                else:
                    last = text[i - 1] if i else "start"
                tail = s.lstrip(MARKS)
                mark = s[: len(s) - len(tail)]
                cite = tail.endswith("]") and "[" in tail
                closers = tail[: tail.index("[")] if cite else tail
                kind = MARK_PAREN if closers[-1:] in tuple(")）") else MARK_QUOTE if closers and closers[-1] != "]" else MARK
                if c in ";;":
                    mark = "greek;" if re.search("[α-ωά-ώ]", text[max(0, i - 80) : i]) and not re.search("[a-zа-я]{4}", text[max(0, i - 24) : i]) else ";"
                gap = "P" if gap.count("\n") > 1 else "L" if "\n" in gap else "S" if gap else "d" if word[:1].isdigit() and prev[-1:].isdigit() else ""
                k = ("m", mark, last, closers[-1:], cite, gap, _kind(word, sign) + ("k" if word.lower() in self.common else ""), word if len(word) <= 6 else "", sign, word[:1] if ord(word[:1] or "a") >= 0x3000 else "")
            elif c.isspace():
                kind = THAI
                beside = text[i - 1].isdigit() or text[j].isdigit()
                k = ("t", beside, "\n" in s, "thai" if 0x0E00 <= ord(text[j]) < 0x0E80 else "other")
            else:
                l, r = text[i - 1 : i], text[j : j + 1]
                if c in "(（":
                    kind = OPEN_P
                elif c in ")）":
                    kind = CLOSE_P
                elif c == "’" and l.isalpha() and r.isalpha():
                    continue
                elif c in "“":
                    kind = EITHER_Q
                else:
                    kind = OPEN_Q if c in _opens else CLOSE_Q if c in _closes + "’" else EITHER_Q
                k = ("q", c, "s" if not l or l.isspace() else "w" if l.isalnum() else "p", "s" if not r or r.isspace() else "w" if r.isalnum() else "p")
            out.append((j if kind != THAI else i, kind, self.key(k)))
        return out


def _features(what: str, *k: object) -> list[str]:
    if what == "t":
        beside, line, nxt = k
        return [f"t:{beside}", f"t:{beside}:{line}:{nxt}"]
    if what == "q":
        c, l, r = k
        return [f"q:{c}", f"q:{c}{l}{r}", f"q:{l}{r}"]
    mark, last, closer, cite, gap, nxt, word, sign, cjk = k
    return [
        f"m:{mark}", f"m:{mark}|{nxt}", f"g:{gap}|{nxt}", f"mg:{mark}|{gap}|{nxt}", f"p:{last}|{nxt}", f"p:{last}", f"p:{last}|{word}", f"w:{word}|{nxt}",
        f"c:{closer}|{nxt}", f"c:{closer}|{mark}", f"c:{closer}{cjk}", f"z:{cite}", f"z:{cite}|{nxt}", f"s:{sign}|{nxt}", f"pm:{last}|{mark}|{gap}",
    ]


class Model:
    def __init__(self) -> None:
        self.w: dict[str, np.ndarray] = {}
        self.t = np.zeros((9, 4, 4))
        # A boundary lies outside: no node leads from within a quotation straight to one but those that close.
        self.allowed = np.zeros((9, 4, 4), bool)
        for kind in range(9):
            for a in range(4):
                for b in range(4):
                    inside = a in (QUOTE, PAREN)
                    self.allowed[kind, a, b] = (
                        (b == a or b == OUT and a == END or b == END and not inside) if kind in (MARK, THAI)
                        else (b != PAREN or a == PAREN) if kind == MARK_QUOTE
                        else (b != QUOTE or a == QUOTE) if kind == MARK_PAREN
                        else (b in (QUOTE, OUT) and not inside or b == a and inside or a == QUOTE and b == OUT) if kind in (OPEN_Q, CLOSE_Q, EITHER_Q)
                        else (b in (PAREN, OUT) and not inside or b == a and inside or a == PAREN and b == OUT)
                    )

    def emission(self, features: list[str]) -> np.ndarray:
        e = np.zeros(4)
        for f in features:
            w = self.w.get(f)
            if w is not None:
                e += w
        return e

    def transitions(self) -> np.ndarray:
        return np.where(self.allowed, self.t, -1e9)


def viterbi(emissions: np.ndarray, kinds: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of a batch: emissions [n, t, 4], kinds [n, t], lengths [n]."""
    n, steps, _ = emissions.shape
    score = np.full((n, 4), -1e9)
    score[:, OUT] = 0
    back = np.zeros((n, steps, 4), np.int8)
    for t in range(steps):
        all_ = score[:, :, None] + trans[kinds[:, t]]
        best = all_.argmax(1)
        back[:, t] = best
        new = np.take_along_axis(all_, best[:, None, :], 1)[:, 0] + emissions[:, t]
        score = np.where((t < lengths)[:, None], new, score)
    labels = np.zeros((n, steps), np.int8)
    state = score.argmax(1)
    for t in range(steps - 1, -1, -1):
        live = t < lengths
        labels[:, t] = np.where(live, state, 0)
        state = np.where(live, back[np.arange(n), t, state], state)
    return labels


def _gold(nodes: list[tuple[int, int, int]], ends: set[int], text: str) -> list[int]:
    """States of a text whose boundaries are known; quotations by their signs."""
    state, out = OUT, []
    for end, kind, _ in nodes:
        if end in ends:
            state = END
        elif kind in (OPEN_Q, EITHER_Q) and state in (OUT, END):
            state = QUOTE
        elif kind == OPEN_P and state in (OUT, END):
            state = PAREN
        elif kind in (CLOSE_Q, EITHER_Q, MARK_QUOTE) and state == QUOTE or kind in (CLOSE_P, MARK_PAREN) and state == PAREN:
            state = OUT
        elif state == END:
            state = OUT
        out.append(state)
    return out


@lru_cache(maxsize=2)
def trained(texts: int = 9000, epochs: int = 5, seed: int = 7) -> Weights:
    """Weights and common words, from ``texts`` labelled texts (the bound of the training sample)."""
    nodes, m = Nodes(common_words()), Model()
    data = []
    for text, ends in labelled_texts(texts, seed):
        n = nodes.of(text)
        if n:
            data.append((n, _gold(n, set(ends), text)))
    w = defaultdict(lambda: np.zeros(4))
    sum_w, sum_t, step = defaultdict(lambda: np.zeros(4)), np.zeros_like(m.t), 0
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for at in range(0, len(data), 6):
            part = data[at : at + 6]
            got_all = _decoded([n for n, _ in part], nodes, w, np.where(m.allowed, m.t, -1e9))
            for (n, gold), got in zip(part, got_all, strict=True):
                step += 1
                if list(got) == gold:
                    continue
                a = b = OUT
                for (_, kind, key), g, y in zip(n, gold, got, strict=True):
                    if g != y:
                        for f in nodes.features[key]:
                            for s, d in ((g, 1.0), (int(y), -1.0)):
                                w[f][s] += d
                                sum_w[f][s] += d * step
                    if (a, g) != (b, y):
                        m.t[kind, a, g] += 1
                        m.t[kind, b, y] -= 1
                        sum_t[kind, a, g] += step
                        sum_t[kind, b, y] -= step
                    a, b = g, int(y)
    average = {f: v - sum_w[f] / step for f, v in w.items()}
    return {f: v for f, v in average.items() if np.abs(v).max() > 0.01}, np.where(m.allowed, m.t - sum_t / step, -1e9), nodes.common


def _decoded(chains: list[list[tuple[int, int, int]]], nodes: Nodes, w: dict[str, np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """Best labels of a few chains under weights that still change."""
    used = sorted({k for n in chains for _, _, k in n})
    zero = np.zeros(4)
    e = np.array([sum((w[f] for f in nodes.features[k] if f in w), zero) for k in used])
    lengths = np.array([len(n) for n in chains])
    kinds, keys = np.zeros((2, len(chains), int(lengths.max())), np.int64)
    for i, n in enumerate(chains):
        kinds[i, : len(n)] = [x[1] for x in n]
        keys[i, : len(n)] = np.searchsorted(used, [x[2] for x in n])
    labels = viterbi(e[keys], kinds, lengths, trans)
    return [labels[i, : len(n)] for i, n in enumerate(chains)]


class Splitter:
    def __init__(self, weights: Weights) -> None:
        self.m = Model()
        self.m.w, self.trans, common = weights
        self.nodes = Nodes(common)
        self.e = np.zeros((0, 4))

    def ends(self, texts: list[str]) -> list[list[int]]:
        """Positions of the last characters of the sentences of each text."""
        if len(self.nodes.keys) > 1 << 18:
            self.nodes, self.e = Nodes(self.nodes.common), np.zeros((0, 4))
        all_ = [self.nodes.of(t) for t in texts]
        new = self.nodes.features[len(self.e) :]
        if new:
            self.e = np.concatenate([self.e, [self.m.emission(f) for f in new]])
        out: list[list[int]] = [[] for _ in texts]
        order = sorted(range(len(texts)), key=lambda i: len(all_[i]))
        for k in range(0, len(order), 128):
            part = order[k : k + 128]
            lengths = np.array([len(all_[i]) for i in part])
            steps = int(lengths.max())
            if steps:
                flat = np.array([x[1:] for i in part for x in all_[i]], np.int64).reshape(-1, 2)
                rows, cols = np.repeat(np.arange(len(part)), lengths), np.concatenate([np.arange(x) for x in lengths])
                kinds, keys = np.zeros((len(part), steps), np.int64), np.zeros((len(part), steps), np.int64)
                kinds[rows, cols], keys[rows, cols] = flat[:, 0], flat[:, 1]
                labels = viterbi(self.e[keys], kinds, lengths, self.trans)
                for r, c in zip(*np.nonzero(labels == END), strict=True):
                    out[part[r]].append(all_[part[r]][c][0])
        for i, t in enumerate(texts):
            last = len(t.rstrip())
            if last and (not out[i] or out[i][-1] < last):
                out[i].append(last)
        return out


def sentence_ends(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, sent_no, start, sent_end) of every text; positions of code points from 1.

    Null ids, and null, empty and blank texts, have no sentence. Repeated rows are split as they
    come. A long text is decoded whole.
    """
    weights = df.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Splitter(weights.value)
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.iloc[at : at + 1024]
                ends = s.ends(list(b["text"]))
                n = [len(e) for e in ends]
                flat = np.fromiter((x for e in ends for x in e), np.int32)
                no = np.concatenate([np.arange(1, x + 1) for x in n] or [np.empty(0)]).astype(np.int32)
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), n), "sent_no": no, "sent_end": flat})

    some = df.select(F.col(id_column).alias("id"), F.col(column).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return some.mapInPandas(run, "id bigint, sent_no int, sent_end int")
