"""Personal information in free text, by a linear-chain conditional random field over word shapes.

The model is trained by stochastic gradient ascent of the conditional log-likelihood on a small
labelled table (``pii_training``), and decoded by Viterbi in numpy batches. The features of a token
(its shape, word, beginning, ending, spacing) count at the token itself and at its neighbours, so what a
token adds at each distance is one row of a table, looked up by the token. Every token of a text is scored.
A token is surely outside where no run of tokens around it can gain by labels of a kind, by a bound of
what their scores and transitions add; so the best labels of a text are those of its other runs, each
decoded between outside tokens. Runs of more than ``PIECE`` tokens are decoded in pieces that overlap by
``LAP`` on either side; a find is taken from the piece in whose inner part it starts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.pii_training import common_words, labelled_sentences

Weights = tuple[dict[str, np.ndarray], np.ndarray, frozenset[str]]
KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
REACH = 3
PIECE, LAP = 1024, 128
#: Tokens whose sums of weights are kept at once.
KEPT = 1 << 16
#: Characters of texts searched together, and tokens scored together.
TOGETHER, SCORED = 1 << 20, 1 << 14
_token = re.compile("[\u3040-\u30ff\u3400-\u9fff々]|(?:นางสาว|นาย|นาง|คุณ)(?=[\u0e01-\u0e2e\u0e40-\u0e44])|[\u0e00-\u0e7f]+|[\u0900-\u0963\u0966-\u097f]+|[^\\W\\d_]+(?:['’-][^\\W\\d_]+)*|\\d+|\\n|[^\\w\\s]|_")

#: A stretch between white space with the blanks before it; the blanks at the end of a text are one without a token.
_stretch = re.compile(r"[^\S\n]*(?:\n|\S+|\Z)")
_number = re.compile(r"\d+")
#: A digit that no number of the training has; it stands for any behind the first one.
ANY = "\U0001d7ce"
_signs = re.compile(r"[^\s\d@。，、；：！？）（\u3040-\u30ff\u3400-\u9fff]*[\d@][^\s。，、；：！？）（\u3040-\u30ff\u3400-\u9fff]*")


def _shape(w: str) -> str:
    c = w[0]
    if c.isdigit():
        return f"d{min(len(w), 12)}"
    o = ord(c)
    if 0x0900 <= o < 0x0980 or 0x0E00 <= o < 0x0E80:
        return "deva" if o < 0x0980 else "thai"
    if not c.isalpha():
        return w
    if 0x3040 <= o < 0x3100:
        return "hira" if o < 0x30A0 else "kata"
    if not (c.isupper() or c.islower()):
        return "han" if o >= 0x3400 else "arab" if 0x0600 <= o < 0x0700 else "caseless"
    script = "" if o < 0x370 else "g" if o < 0x400 else "c"
    if len(w) == 1:
        return script + ("X" if c.isupper() else "x")
    part = w.rpartition("-")[2]
    return script + ("XX" if w.isupper() else "Xx" if c.isupper() else "xx") + ("'" if "'" in w or "’" in w else "") + ("" if part == w else "-X" if part[:1].isupper() else "-x")


def _chunk(c: str) -> str:
    """The shape of a stretch between white space that holds digits or an at sign; '' of any other."""
    if "@" in c:
        return "@"
    if not any(x.isdigit() for x in c):
        return ""
    c = re.sub(r"[^\W\d_]+", lambda m: ("A" if m[0].isupper() else "a") * min(len(m[0]), 2), c.strip(".,;:!?\"'“”«»()[]<>。，、；：！？）（"))
    return re.sub(r"\d+", lambda m: str(min(len(m[0]), 12)), c)[:24]


def _features(w: str, spaced: bool, chunk: str, common: frozenset[str]) -> list[str]:
    s = _shape(w)
    out = [f"s:{s}", f"s:{s}|{spaced}", f"w:{w.lower()}"]
    if chunk:
        out += [f"c:{chunk}", f"c:{chunk}|{s}", f"c:{chunk}|{spaced}"]
    if w[0].isdigit():
        out += [f"b:{w[:1]}|{s}", "digits"]
    elif w[0].isalpha():
        known = w.lower() in common or "-" in w and all(x in common for x in w.lower().split("-"))
        out += [f"e:{w[-3:].lower()}|{s}", f"e:{w[-2:].lower()}|{s}", f"n:{min(len(w), 12)}|{s}", f"w:{w}|{s}", f"a:{w[:2]}", f"v:{known}|{s}", f"v:{known}|{s}|{spaced}"]
    return out


class Tokens:
    """Tokens of texts as ids; each id knows its features. ``numbers``: those known by themselves, of all others only
    the first digit and the length make features; None: all are known."""

    def __init__(self, common: frozenset[str], numbers: frozenset[str] | None = None) -> None:
        self.common, self.numbers = common, numbers
        self.memo: dict[str, tuple[tuple[int, ...], tuple[tuple[int, int], ...]]] = {}
        self.alike: dict[str, tuple[tuple[int, ...], tuple[tuple[int, int], ...]]] = {}
        self.ids: dict[tuple[str, bool, str], int] = {("\x00", False, ""): 0}
        self.features: list[list[str]] = [["s:edge"]]

    def of(self, text: str) -> np.ndarray:
        """Ids of a text's tokens. A stretch is taken apart once."""
        memo, out = self.memo, []
        for s in _stretch.findall(text):
            got = memo.get(s)
            if got is None:
                got = memo[s] = self._known(s)
            out.append(got[0])
        return np.fromiter(chain.from_iterable(out), np.int32)

    def places(self, text: str) -> list[tuple[int, int]]:
        """The places of the tokens of a text that ``of`` has seen."""
        out, a = [], 0
        for s in _stretch.findall(text):
            out += [(a + x, a + y) for x, y in self.memo[s][1]]
            a += len(s)
        return out

    def _plain(self, m: re.Match[str]) -> str:
        return m[0] if m[0] in self.numbers or not m[0].isascii() else m[0][0] + ANY * (len(m[0]) - 1)

    def _known(self, stretch: str) -> tuple[tuple[int, ...], tuple[tuple[int, int], ...]]:
        if self.numbers is None:
            return self._apart(stretch)
        plain = _number.sub(self._plain, stretch)
        if plain == stretch:
            return self._apart(stretch)
        if plain not in self.alike:
            self.alike[plain] = self._apart(plain)
        return self.alike[plain]

    def _apart(self, stretch: str) -> tuple[tuple[int, ...], tuple[tuple[int, int], ...]]:
        body = stretch.lstrip() or "\n" * stretch.endswith("\n")
        blanks = len(stretch) - len(body)
        ids, at, known = [], [], self.ids
        signs = [(m.start(), m.end(), _chunk(m[0])) for m in _signs.finditer(body)]
        signs.append((len(body) + 1, len(body) + 1, ""))
        n = 0
        for m in _token.finditer(body):
            a = m.start()
            while a >= signs[n][1]:
                n += 1
            k = (m[0], blanks > 0 and a == 0, signs[n][2] if a >= signs[n][0] else "")
            i = known.get(k)
            if i is None:
                i = known[k] = len(self.features)
                self.features.append(_features(*k, self.common))
            ids.append(i)
            at.append((blanks + a, blanks + m.end()))
        return tuple(ids), tuple(at)


def _padded(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    ids = np.zeros((len(rows), int(n.max()) + 2 * REACH), np.int64)
    for i, r in enumerate(rows):
        ids[i, REACH : REACH + len(r)] = r
    return ids, n


def _emissions(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """table: [id, distance, label]; sums what each token and its neighbours add."""
    t = ids.shape[1] - 2 * REACH
    return sum(table[ids[:, d : d + t], d] for d in range(2 * REACH + 1))


def _allowed() -> np.ndarray:
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                ok[i, j] = a[2:] == b[2:] and a != "O"
    return ok


_START = np.array([-1e9 if x[0] == "I" else 0.0 for x in LABELS], np.float32)


def decode(em: np.ndarray, n: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels of a batch. Only a label's own beginning and inside lead inside it, so each step looks at
    the best of all labels and at those two."""
    rows, steps, k = em.shape
    score, back = em[:, 0] + _START, np.zeros((rows, steps, k), np.int8)
    inside = np.arange(2, k, 2)
    outside = np.r_[0, np.arange(1, k, 2)]
    into = trans[:, outside]
    for t in range(1, steps):
        # To O and to beginnings from anywhere; to an inside from its beginning or itself.
        all_ = score[:, :, None] + into
        best = all_.argmax(1)
        begun, stayed = score[:, inside - 1] + trans[inside - 1, inside], score[:, inside] + trans[inside, inside]
        stay = stayed > begun
        new = np.empty_like(score)
        new[:, outside] = all_.max(1)
        new[:, inside] = np.where(stay, stayed, begun)
        back[:, t, outside] = best
        back[:, t, inside] = np.where(stay, inside, inside - 1)
        score = np.where((t < n)[:, None], new + em[:, t], score)
    out, state = np.zeros((rows, steps), np.int8), score.argmax(1)
    at = np.arange(rows)
    for t in range(steps - 1, -1, -1):
        live = t < n
        out[:, t] = np.where(live, state, 0)
        if t:
            state = np.where(live, back[at, t, state], state)
    return out


@lru_cache(maxsize=2)
def trained(sentences: int = 14000, epochs: int = 6, seed: int = 11, least: int = 8) -> Weights:
    """(weights [distance, label] of each feature, transitions, common words), from ``sentences`` labelled texts (the
    bound of the training sample). Forward and backward sums are scaled at each step; a batch changes the
    weights of its own features only (AdaGrad)."""
    tokens, data = Tokens(common_words()), []
    for text, spans in labelled_sentences(sentences, seed):
        ids, at = tokens.of(text).tolist(), tokens.places(text)
        tags = np.zeros(len(ids), np.int64)
        for a, b, kind in spans:
            first = True
            for i, (x, y) in enumerate(at):
                if a <= x and y <= b:
                    tags[i] = LABELS.index(("B-" if first else "I-") + kind)
                    first = False
        if ids:
            data.append((ids, tags))
    # What only a few texts have says nothing on other texts: unknown words are to be told by what they look like.
    often = Counter(f for ids, _ in data for f in {f for i in set(ids) for f in tokens.features[i]})
    names = sorted(f for f, n in often.items() if n >= least) + ["s:edge"]
    known = set(names)
    tokens.features = [[f for f in fs if f in known] for fs in tokens.features]
    number = {f: i for i, f in enumerate(names)}
    width = max(map(len, tokens.features))
    feats = np.full((len(tokens.features), width), len(names))
    for i, fs in enumerate(tokens.features):
        feats[i, : len(fs)] = [number[f] for f in fs]
    d, k = 2 * REACH + 1, len(LABELS)
    w, trans = np.zeros((len(names) + 1, d, k), np.float32), np.zeros((k, k))
    gw, gt = np.full(w.shape, 1e-6, np.float32), np.full(trans.shape, 1e-6)
    ok = _allowed()
    start = np.exp(_START)
    r = np.random.default_rng(seed)
    order = sorted(range(len(data)), key=lambda i: len(data[i][0]))
    batches = [order[i : i + 48] for i in range(0, len(order), 48)]
    for epoch in range(epochs):
        rate = 0.25 / (1 + epoch / 2)
        for bi in r.permutation(len(batches)):
            part = [data[i] for i in batches[bi]]
            ids, n = _padded([p[0] for p in part])
            rows, steps = len(part), ids.shape[1] - 2 * REACH
            gold = np.zeros((rows, steps), np.int64)
            for i, (_, tags) in enumerate(part):
                gold[i, : len(tags)] = tags
            mask = np.arange(steps)[None, :] < n[:, None]
            used, back = np.unique(ids, return_inverse=True)
            idx = back.reshape(ids.shape)
            table = w[feats[used]].sum(1)
            em = _emissions(table, idx).astype(np.float64)
            e = np.exp(em - em.max(2, keepdims=True))
            tr = np.where(ok, np.exp(trans), 0.0)
            fwd, scale = np.zeros((steps, rows, k)), np.ones((steps, rows, 1))
            x = e[:, 0] * start
            for t in range(steps):
                if t:
                    x = np.where(mask[:, t, None], (fwd[t - 1] @ tr) * e[:, t], fwd[t - 1])
                scale[t] = x.sum(1, keepdims=True)
                fwd[t] = x / scale[t]
            bwd, pair = np.ones((steps, rows, k)), np.zeros((k, k))
            for t in range(steps - 2, -1, -1):
                y = e[:, t + 1] * bwd[t + 1] / scale[t + 1]
                bwd[t] = np.where(mask[:, t + 1, None], y @ tr.T, bwd[t + 1])
                pair += (fwd[t] * mask[:, t + 1, None]).T @ y * tr
            prob = (fwd * bwd).transpose(1, 0, 2)
            g = -prob / np.maximum(prob.sum(2, keepdims=True), 1e-30)
            g[np.arange(rows)[:, None], np.arange(steps)[None], gold] += 1
            g = (g * mask[:, :, None]).astype(np.float32)
            gpair = -pair
            np.add.at(gpair, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
            gtable = np.zeros_like(table)
            for dist in range(d):
                flat = idx[:, dist : dist + steps].ravel()
                o = np.argsort(flat, kind="stable")
                at = np.flatnonzero(np.r_[True, flat[o][1:] != flat[o][:-1]])
                gtable[flat[o][at], dist] = np.add.reduceat(g.reshape(-1, k)[o], at)
            flat = feats[used].ravel()
            o = np.argsort(flat, kind="stable")
            o = o[: np.searchsorted(flat[o], len(names))]
            at = np.flatnonzero(np.r_[True, flat[o][1:] != flat[o][:-1]])
            own, grad = flat[o][at], np.add.reduceat(gtable[o // width], at)
            gw[own] += grad**2
            gt += gpair**2
            w[own] = (w[own] + rate * grad / np.sqrt(gw[own])) * (1 - 2e-4)
            trans += rate * gpair / np.sqrt(gt)
    # Features that tell nothing aren't handed on.
    return {f: w[i] for f, i in number.items() if np.abs(w[i]).max() > 0.02}, np.where(ok, trans, -1e9).astype(np.float32), tokens.common


def shared(spark: SparkSession) -> Broadcast:
    """The trained weights, broadcast once a session: their size is bounded by the training sample."""
    key = spark.sparkContext.applicationId
    if key not in _SHARED:
        _SHARED[key] = spark.sparkContext.broadcast(trained())
    return _SHARED[key]


_SHARED: dict[str, Broadcast] = {}


def _bound(trans: np.ndarray) -> np.ndarray:
    """What each label adds at most by transitions, against staying outside: over any run of tokens inside, the
    transitions into, within and out of it add no more than its labels' bounds."""
    r = (trans - trans[0, 0]).astype(np.float64)
    # Leaving a label is paid where it is entered, and at the end of a text nothing is left.
    leave = np.minimum(-r[:, 0], 0.0)
    leave[0] = 0.0
    into = (r + leave[:, None] - leave[None]).max(0)
    return np.where(_START < 0, into, np.maximum(into, -leave)).astype(np.float32)


class Finder:
    def __init__(self, weights: Weights) -> None:
        w, self.trans, self.common = weights
        self.number = {f: i for i, f in enumerate(w)}
        self.w = np.concatenate([np.array(list(w.values()), np.float32).reshape(-1, 2 * REACH + 1, len(LABELS)), np.zeros((1, 2 * REACH + 1, len(LABELS)), np.float32)])
        self.bound = _bound(self.trans)
        self.numbers = frozenset(f[2:] for f in w if f[:2] == "w:" and f[2:3].isdigit())
        self.table = np.zeros((1024, *self.w.shape[1:]), np.float32)
        self._renew()

    def _renew(self) -> None:
        self.tokens, self.filled = Tokens(self.common, self.numbers), 0

    def _fill(self) -> None:
        """Rows of the table for new tokens: the sums of their features' weights."""
        new, get, none = self.tokens.features[self.filled :], self.number.get, len(self.w) - 1
        if len(self.tokens.features) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((len(self.tokens.features), *self.w.shape[1:]), np.float32)])
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            # Each token has at least the entry without weights, so that no stretch is empty.
            flat = [[none, *(i for f in fs if (i := get(f)) is not None)] for fs in part]
            n = np.array([len(x) for x in flat])
            rows = self.w[np.fromiter((i for x in flat for i in x), np.int64, int(n.sum()))]
            self.table[self.filled + at : self.filled + at + len(part)] = np.add.reduceat(rows, np.r_[0, np.cumsum(n)[:-1]], axis=0)
        self.filled = len(self.tokens.features)

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of what each text holds, as offsets."""
        out, a, size = [], 0, 0
        for b, t in enumerate(texts):
            if size and size + len(t) > TOGETHER:
                out += self._find(texts[a:b])
                a, size = b, 0
            size += len(t)
        return out + self._find(texts[a:])

    def _inside(self, flat: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Which tokens may have a label: those in a run whose bounds of gain sum to no less than nothing."""
        gain = np.full(len(flat), -1e6)
        for at in range(REACH, len(flat) - REACH, SCORED):
            end = min(at + SCORED, len(flat) - REACH)
            em = _emissions(self.table, flat[None, at - REACH : end + REACH])[0]
            gain[at:end] = (em[:, 1:] + self.bound[1:]).max(1) - em[:, 0]
        gain[~token] = -1e6
        sums = np.r_[0.0, np.cumsum(gain)]
        most = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
        # Room for the rounding of sums.
        return token & (most > -0.01)

    def _find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        if len(self.tokens.ids) > KEPT or len(self.tokens.memo) > 4 * KEPT:
            self._renew()
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        rows = [self.tokens.of(t) for t in texts]
        self._fill()
        # All texts one behind the other, with edges around each.
        edge = np.zeros(REACH, np.int32)
        flat = np.concatenate([x for r in rows for x in (edge, r)] + [edge])
        n = np.array([len(r) for r in rows], np.int64)
        first = np.cumsum(np.r_[0, n[:-1]]) + REACH * np.arange(1, len(n) + 1)
        token = np.zeros(len(flat) + 1, np.int8)
        np.add.at(token, first, 1)
        np.add.at(token, first + n, -1)
        token = np.cumsum(token)[:-1] > 0
        inside = self._inside(flat, token)
        step = np.diff(np.r_[0, inside.astype(np.int8), 0])
        work = []
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            # With the outside tokens around it, which lead in and out.
            x, y = a - int(token[a - 1]), b + int(token[b])
            for at in range(x, y, PIECE):
                work.append((max(x, at - LAP), min(y, at + PIECE + LAP), at, min(y, at + PIECE)))
        work.sort(key=lambda w: w[1] - w[0])
        known: dict[int, list[tuple[int, int]]] = {}
        at = 0
        while at < len(work):
            # Batches of a bounded number of tokens.
            size = max(1, min(2048, 100_000 // (work[min(at + 2047, len(work) - 1)][1] - work[min(at + 2047, len(work) - 1)][0])))
            part = work[at : at + size]
            at += size
            begin, end = np.array([w[0] for w in part]), np.array([w[1] for w in part])
            long = int((end - begin).max())
            ids = flat[np.minimum(begin[:, None] + np.arange(-REACH, long + REACH), len(flat) - 1)]
            em = _emissions(self.table, ids)
            em[~inside[np.minimum(begin[:, None] + np.arange(long), len(flat) - 1)], 1:] = -1e9
            tags = decode(em, end - begin, self.trans)
            for row in np.flatnonzero(tags.any(1)):
                a, b, x, y = part[row]
                i = int(np.searchsorted(first, a, "right")) - 1
                if i not in known:
                    known[i] = self.tokens.places(texts[i])
                out[i] += _spans(texts[i], known[i][a - first[i] : b - first[i]], tags[row, : b - a], x - a, y - a)
        return [sorted(x) for x in out]


def _spans(text: str, at: list[tuple[int, int]], tags: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int, str]]:
    i = 0
    while i < len(at):
        if tags[i] and tags[i] % 2:
            j = i + 1
            while j < len(at) and tags[j] == tags[i] + 1:
                j += 1
            kind = LABELS[tags[i]][2:]
            found = _exact(kind, text, at[i][0], at[j - 1][1]) if first <= i < last else None
            if found:
                yield *found, kind
            i = j
        else:
            i += 1


def _is_name(s: str) -> bool:
    """At least two parts, in scripts with capitals the outer ones with one, and one of them no initial."""
    parts = [p for p in re.split(r"[\s,]+", s) if p]
    if not parts or not (parts[0][0].isalpha() and parts[-1][0].isalpha()):
        return False
    if not (parts[0][0].isupper() or parts[0][0].islower()):
        return sum(c.isalpha() for c in s) > 1
    full = [p for p in parts if p[0].isupper() and len(p.rstrip(".")) > 1 and p[-1] != "."]
    return len(parts) > 1 and parts[0][0].isupper() and parts[-1][0].isupper() and bool(full)


def _exact(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """A plain check of what the model found: signs around it are taken off, and it must have what makes its kind."""
    while a < b and text[a] in " \n,;:.<>(（：，、。" and not (kind == "phone" and text[a] == "("):
        a += 1
    while b > a and (text[b - 1] in " \n,;:<>（(。、，」" or text[b - 1] in ")）" and not {"(", "（"} & set(text[a:b]) or text[b - 1] == "." and kind not in ("name", "address")):
        b -= 1
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    ok = {
        "email": len(s) > 4 and ("@" in s or "at" in s.lower()),
        "phone": digits >= 7,
        "id_number": digits >= 5,
        "address": digits > 0,
        "name": digits == 0 and _is_name(s),
    }[kind]
    return (a, b) if ok else None


def find_personal(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, kind, start_pos, end_pos): places of personal information, code points from 1, inclusive.

    Null ids and null or empty texts hold none. Repeated rows are searched as they come.
    """
    weights = shared(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Finder(weights.value)
        for b in batches:
            rows = [(i, k, x + 1, y) for i, found in zip(b["id"], f.find(list(b["text"])), strict=True) for x, y, k in found]
            yield pd.DataFrame(rows, columns=["id", "kind", "start_pos", "end_pos"])

    some = df.select(F.col(id_column).alias("id"), F.col(column).alias("text")).where(F.col("id").isNotNull() & (F.length("text") > 0))
    return some.mapInPandas(run, "id bigint, kind string, start_pos int, end_pos int")


def masked_text(df: DataFrame, column: str, out: str = "masked") -> DataFrame:
    """``df`` with the text in which each find is replaced by its kind in square brackets."""
    weights = shared(df.sparkSession)

    @F.pandas_udf("string")
    def mask(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Finder(weights.value)
        for s in it:
            texts = [x or "" for x in s]
            done = []
            for t, found, given in zip(texts, f.find(texts), s, strict=True):
                parts, last = [], 0
                for a, b, k in found:
                    parts += [t[last:a], f"[{k.upper()}]"]
                    last = b
                done.append(None if given is None else "".join(parts) + t[last:])
            yield pd.Series(done)

    return df.withColumn(out, mask(F.col(column)))
