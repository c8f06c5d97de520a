"""Near-duplicate texts by anchor-point covering of word-set fingerprints.

Two word sets of which at least 80 % of the union is common differ in at most (|a| + |b|) / 9 words.
Words are hashed to bands; in each band a parity fingerprint has the bits that an odd number of
words of the band flip, so two fingerprints differ in no more bits than the sets differ in
words. With D differences at most and b = D // (T + 1) + 1 bands, some band differs by at most T.

In each band the anchors are the words of a covering code with radius R. A fingerprint is sent to its
nearest anchor (at distance R at most) and, to be met by all within T, to every anchor within R + T.
Sets of few words use the perfect Hamming code of 15 bits (R = 1, T = 1): with T = 1 the two of a
pair that differ have even and odd parity in the band, so only odd ones go to all anchors within R
+ T. Larger sets have many bands; there the code is the whole space (R = 0, T = 0), the
fingerprint has 64 bits, and some spare bands allow each set to leave out as many that tell least.
Nothing is lost either way: the cover is exact, not probable.

Per anchor, all that met there are compared in blocks of numpy arrays by a wider fingerprint, whose
distance is a lower bound of the sets' difference; only what may still be a pair leaves the task,
and the words themselves decide. Anchors that very many records reach (``HOT``) are cut into blocks,
and the pairs of blocks are spread over tasks.

Equal texts are one class: they are fingerprinted once per task and compared as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import staged

#: Similarity in fifths: common words / words of the union >= 4 / 5.
NUM, DEN = 4, 5
#: Upper sizes grow by this factor from class to class of set sizes.
GROWTH = 1.5625
#: Sets up to this size use the Hamming code, larger ones many bands with exact anchors.
SMALL = 12
#: Classes of larger sets carry a fingerprint of 512 bits besides; 112 bits tell them too little.
WIDE = 130
#: Spare bands of larger sets, as a part of the bands that are needed.
SPARE = 0.5
#: Rows of one anchor compared in one task; more are cut into blocks.
HOT = 16_384
#: Records of a class of equal texts that are given in pairs with all others of the class.
COPIES = 8
_M = np.uint64(0x9E3779B97F4A7C15)


def classes(most: int) -> np.ndarray:
    """Upper sizes of the classes, the last at least ``most``."""
    up = [4]
    while up[-1] < most:
        up.append(int((up[-1] + 1) * GROWTH))
    return np.array(up)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """64-bit hashes of the set of lower-cased words, split at white space, punctuation kept. The lowest
    three bits say how much a word tells: longer words, and such with digits, are rarer."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1 << 19:
            self.clear()
        tells = min(7, 1 + (len(w) > 4) + (len(w) > 7) + 3 * any(c.isdigit() for c in w))
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & ~7 | tells
        return h

    def of(self, text: str) -> list[int]:
        return list(map(self.__getitem__, set(text.lower().split())))


def _pairs15() -> np.ndarray:
    """For each syndrome s the flips that lead from a fingerprint to all code words within 2."""
    out = np.zeros((16, 8), np.uint64)
    for s in range(1, 16):
        flips = [1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 16) if i < i ^ s]
        out[s] = flips
    return out


_FLIPS = _pairs15()


def anchor_rows(tbl: np.ndarray, doc: np.ndarray, sets: list[list[int]]) -> dict[str, np.ndarray]:
    """Rows (key, doc, f1, f2) of a batch: anchor keys with the wide fingerprint; f2 holds in its
    upper 16 bits the set size (15 bits, saturated) and whether the row is only a visitor there."""
    n = np.array([len(s) for s in sets], np.int64)
    words = np.fromiter((w for s in sets for w in s), np.uint64, int(n.sum()))
    of = np.repeat(np.arange(len(sets)), n)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    bit = _mix(words)
    low = np.where(bit & np.uint64(64), np.uint64(0), np.uint64(1) << (bit & np.uint64(63)))
    high = np.where(bit & np.uint64(64), np.uint64(1) << (bit & np.uint64(63)) % np.uint64(48), np.uint64(0))
    f1, f2 = np.bitwise_xor.reduceat(low, starts), np.bitwise_xor.reduceat(high, starts)
    f2 |= np.minimum(n, 32767).astype(np.uint64) << np.uint64(48)

    up = classes(int(n.max()))
    tops = np.r_[up, int((up[-1] + 1) * GROWTH)]
    own = np.searchsorted(up, n)
    # The next class has partners only for sets within 4/5 of its smallest size.
    visits_next = n * DEN >= (up[own] + 1) * NUM
    # Distances bound the difference only if both rows have the wide fingerprint: it goes by the class.
    large = np.flatnonzero(tops[own + visits_next] > WIDE)
    spot = np.full(len(n), -1)
    spot[large] = np.arange(len(large))
    wide = np.zeros((len(large), 8), np.uint64)
    of_large = spot[of] >= 0
    b512 = _mix(words[of_large] + np.uint64(3))
    np.bitwise_xor.at(wide, (spot[of[of_large]], ((b512 >> np.uint64(6)) & np.uint64(7)).astype(np.int64)), np.uint64(1) << (b512 & np.uint64(63)))
    packed = [w.tobytes() for w in wide]

    keys, docs, visits, wides = [], [], [], []
    for step in (0, 1):
        use = visits_next if step else np.ones(len(n), bool)
        if step and not use.any():
            continue
        top = tops[own + step]
        d = 2 * top // 9
        # Without a difference only equal sets are pairs: one band, met by equality.
        few = (top <= SMALL) & (d > 0)
        spare = np.where(few | (d == 0), 0, np.ceil((d + 1) * SPARE).astype(np.int64))
        bands = np.where(few, d // 2 + 1, d + 1 + spare)
        pick = use[of]
        w, o = words[pick], of[pick]
        band = ((w >> np.uint64(20)) % bands[o].astype(np.uint64)).astype(np.int64)
        # One entry a (set, band), empty bands too.
        base = np.concatenate([[0], np.cumsum(np.where(use, bands, 0))])
        cell = base[o] + band
        order = np.argsort(cell, kind="stable")
        w, cell = w[order], cell[order]
        total = int(base[-1])
        at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        fp, syn, cnt = np.zeros(total, np.uint64), np.zeros(total, np.uint64), np.zeros(total, np.uint64)
        who = np.repeat(np.arange(len(n)), np.where(use, bands, 0))
        ham = few[who]
        pos15 = _mix(w + np.uint64(1)) % np.uint64(15)
        b15, b64 = np.uint64(1) << pos15, _mix(w + np.uint64(2))
        filled = cell[at]
        fp[filled] = np.where(ham[filled], np.bitwise_xor.reduceat(b15, at), np.bitwise_xor.reduceat(b64, at))
        syn[filled] = np.bitwise_xor.reduceat(pos15 + np.uint64(1), at)
        cnt[filled] = np.diff(np.r_[at, len(cell)])
        where = np.arange(total) - base[who]
        salt = _mix((top[who].astype(np.uint64) << np.uint64(24)) ^ (where.astype(np.uint64) << np.uint64(2)) ^ np.where(tbl[who] != 0, np.uint64(1), np.uint64(0)))
        # Exact anchors: nothing within 0 but the fingerprint itself. At least spare + 1 bands of a pair are
        # equal, so each set may leave out the spare ones that tell least: the order of bands is one of
        # their contents, and of the pair's equal bands the last in it is left out by neither.
        tells = np.zeros(total, np.uint64)
        tells[filled] = np.add.reduceat(w & np.uint64(7), at)
        rank = np.lexsort((_mix(fp ^ salt), tells, who))
        place = np.empty(total, np.int64)
        place[rank] = np.arange(total) - base[who[rank]]
        plain = ~ham & (place >= spare[who])
        keys.append(_mix(fp[plain] ^ salt[plain]) ^ cnt[plain])
        docs.append(doc[who[plain]])
        visits.append(np.column_stack([who[plain], np.zeros(plain.sum(), np.int64)]))
        wides.append(np.where(top[who[plain]] > WIDE, spot[who[plain]], -1))
        # Hamming anchors: the nearest one, and for odd parity all within 2.
        h = np.flatnonzero(ham)
        s = syn[h].astype(np.int64)
        near = fp[h] ^ np.where(s > 0, np.uint64(1) << (np.maximum(s, 1) - 1).astype(np.uint64), np.uint64(0))
        keys.append(_mix(near ^ salt[h]))
        docs.append(doc[who[h]])
        visits.append(np.column_stack([who[h], np.zeros(len(h), np.int64)]))
        wides.append(np.full(len(h) , -1))
        odd = h[(cnt[h] % np.uint64(2) == 1) & (s > 0)]
        far = fp[odd][:, None] ^ _FLIPS[syn[odd].astype(np.int64)][:, 1:]
        keys.append(_mix(far ^ salt[odd][:, None]).ravel())
        docs.append(np.repeat(doc[who[odd]], 7))
        visits.append(np.column_stack([np.repeat(who[odd], 7), np.ones(7 * len(odd), np.int64)]))
        wides.append(np.full(7 * len(odd), -1))
    who, visit = np.concatenate(visits).T
    return {
        "key": np.concatenate(keys).view(np.int64),
        "doc": np.concatenate(docs),
        "f1": f1[who].view(np.int64),
        "f2": (f2[who] | (visit.astype(np.uint64) << np.uint64(63))).view(np.int64),
        "wide": [packed[i] if i >= 0 else None for i in np.concatenate(wides)],
    }


def _may_pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and y (key, doc, f1, f2, wide...; they broadcast) may be near-duplicates."""
    low = np.uint64((1 << 48) - 1)
    f, g = x[..., 2:4].view(np.uint64), y[..., 2:4].view(np.uint64)
    n, m = ((f[..., 1] >> np.uint64(48)) & np.uint64(32767)).astype(np.int32), ((g[..., 1] >> np.uint64(48)) & np.uint64(32767)).astype(np.int32)
    most = (n + m) // 9
    ok = np.bitwise_count(f[..., 0] ^ g[..., 0]) + np.bitwise_count((f[..., 1] ^ g[..., 1]) & low) <= most
    if x.shape[-1] > 4 and ok.any() and x[..., 4:].any():
        diff = np.zeros(ok.shape, np.int32)
        for k in range(4, 12):
            diff += np.bitwise_count(x[..., k].view(np.uint64) ^ y[..., k].view(np.uint64))
        ok &= diff <= most
    big = 32767
    ok |= (n == big) | (m == big)
    if ok.any():
        ok &= (n * DEN >= m * NUM) & (m * DEN >= n * NUM)
        ok &= (f[..., 1] & g[..., 1]) >> np.uint64(63) == 0
        ok &= x[..., 1] != y[..., 1]
    return ok


def _limit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes of rows, and the most differences to any set that may be near: it has at most 5/4 as many words."""
    n = ((x[:, 3].view(np.uint64) >> np.uint64(48)) & np.uint64(32767)).astype(np.int64)
    return n, np.minimum(n // 4, 32767).astype(np.uint16)


def _cross(a: np.ndarray, b: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pairs of ``compare`` of the rows of a, or of a and b; only sizes that may be near meet, and what the
    fingerprint alone tells apart goes no further."""
    same = b is None
    a = a[np.argsort(_limit(a)[0], kind="stable")]
    b = a if same else b[np.argsort(_limit(b)[0], kind="stable")]
    (n, most), m = _limit(a), _limit(b)[0]
    wide = len(a) and len(b) and a[:, 4:].any(1).all() and b[:, 4:].any(1).all()
    bits = [(k, -1) for k in range(4, 12)] if wide else [(2, -1), (3, (1 << 48) - 1)]
    f, g = ([x[:, k] & mask for k, mask in bits] for x in (a, b))
    kind = np.uint16 if wide else np.uint8
    most = np.minimum(most, np.iinfo(kind).max).astype(kind)
    for i in range(0, len(a), 128):
        k = min(i + 128, len(a))
        low = i if same else int(np.searchsorted(m, -(-n[i] * NUM // DEN)))
        high = int(np.searchsorted(m, n[k - 1] * DEN // NUM, "right"))
        for j in range(low, high, 1024):
            e = min(j + 1024, high)
            diff = np.zeros((k - i, e - j), kind)
            for x, y in zip(f, g, strict=True):
                diff += np.bitwise_count((x[i:k, None] ^ y[None, j:e]).view(np.uint64))
            p, q = np.nonzero(diff <= most[i:k, None])
            p, q = i + p, j + q
            if same:
                p, q = p[q > p], q[q > p]
            ok = _may_pair(a[p], b[q])
            if ok.any():
                u, v = a[p[ok], 1], b[q[ok], 1]
                yield np.column_stack([np.minimum(u, v), np.maximum(u, v)])


def compare(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Pairs (doc, doc) of the rows of one anchor, or of two blocks of it, that may be near-duplicates. Two visitors
    are compared elsewhere."""
    other = a if b is None else b
    out = [*_cross(a[a[:, 3] >= 0], None if b is None else b[b[:, 3] >= 0]), *_cross(a[a[:, 3] >= 0], other[other[:, 3] < 0])]
    if b is not None:
        out += _cross(a[a[:, 3] < 0], b[b[:, 3] >= 0])
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)


_FOUND = "kind int, key bigint, a bigint, b bigint, f1 bigint, f2 bigint, wide binary, block int"


def _emit(pairs: np.ndarray) -> pd.DataFrame:
    z = np.zeros(len(pairs), np.int64)
    return pd.DataFrame({"kind": z.astype(np.int32), "key": z, "a": pairs[:, 0], "b": pairs[:, 1], "f1": z, "f2": z, "wide": None, "block": z.astype(np.int32)})


def _compare_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key; runs of equal keys are compared, hot runs passed on in blocks."""
    held: list[np.ndarray] = []
    hot_key, hot_rows = None, 0

    def rows(b: pd.DataFrame) -> np.ndarray:
        return _matrix(b, ("key", "doc", "f1", "f2"))

    def defer(x: np.ndarray, seen: int) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.int32(1), "key": x[:, 0], "a": x[:, 1], "b": np.int64(0), "f1": x[:, 2], "f2": x[:, 3], "wide": [r.tobytes() if r.any() else None for r in x[:, 4:]], "block": ((np.arange(len(x)) + seen) // HOT).astype(np.int32)})

    def closed(x: np.ndarray) -> Iterator[pd.DataFrame]:
        """All runs of x are complete."""
        at = np.flatnonzero(np.r_[True, x[1:, 0] != x[:-1, 0], True])
        size = np.diff(at)
        found = []
        bits, most = np.ascontiguousarray(x[:, 2]).view(np.uint64), _limit(x)[1]
        for s in np.unique(size[size > 1]):
            starts = at[:-1][size == s]
            if s <= 48:
                # Runs of one size side by side: one comparison for all of them.
                p, q = np.triu_indices(s, 1)
                step = max(1, 300_000 // len(p))
                for k in range(0, len(starts), step):
                    base = starts[k : k + step, None]
                    i, j = (base + p).ravel(), (base + q).ravel()
                    near = np.bitwise_count(bits[i] ^ bits[j]) <= most[i]
                    found.append(_pairwise(x, i[near], j[near]))
            else:
                for k in starts:
                    found.append(compare(x[k : k + s]))
        if found:
            yield _emit(np.unique(np.concatenate(found), axis=0))

    for b in batches:
        x = rows(b)
        if not len(x):
            continue
        if hot_key is not None:
            same = int(np.searchsorted(x[:, 0] != hot_key, True))
            if same:
                yield defer(x[:same], hot_rows)
                hot_rows += same
                x = x[same:]
            if not len(x):
                continue
            hot_key, hot_rows = None, 0
        held.append(x)
        if held[0][0, 0] == x[-1, 0] and sum(map(len, held)) <= HOT:
            continue
        x = np.concatenate(held)
        last = int(np.flatnonzero(np.r_[True, x[1:, 0] != x[:-1, 0]])[-1])
        if last:
            yield from closed(x[:last])
        held = [np.ascontiguousarray(x[last:])]
        if len(held[0]) > HOT:
            hot_key, hot_rows = held[0][0, 0], len(held[0])
            yield defer(held[0], 0)
            held = []
    if held:
        yield from closed(np.concatenate(held))


def _pairwise(x: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    ok = _may_pair(x[p], x[q])
    u, v = x[p[ok], 1], x[q[ok], 1]
    return np.column_stack([np.minimum(u, v), np.maximum(u, v)])


def _matrix(b: pd.DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    """Rows as int64; behind the columns the wide fingerprint, zeros where there is none."""
    x = np.zeros((len(b), 12), np.int64)
    for i, c in enumerate(columns):
        x[:, i] = b[c].to_numpy(np.int64)
    has = np.flatnonzero(b["wide"].notna().to_numpy())
    if len(has):
        x[has, 4:] = np.frombuffer(b"".join(b["wide"].to_numpy()[has]), np.int64).reshape(-1, 8)
    return x


def text_key(seed: int) -> Column:
    """64-bit key of a text; ``_classes`` takes a seed with which different texts have different keys."""
    return F.xxhash64("content") if seed == 0 else F.xxhash64(F.lit(seed), "content")


def text_links(texts: DataFrame, seed: int = 0) -> DataFrame:
    """Links between different texts: tbl, a < b (keys of the texts), common, together.

    ``texts``: tbl, id, content. Texts without a word never count.
    """
    spark = texts.sparkSession
    some = texts.where(F.col("content").isNotNull() & F.col("content").rlike(r"(?U)\S")).select("tbl", "content", text_key(seed).alias("doc"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen = Words(), set()
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.iloc[at : at + 512]
                fresh = []
                for t, d in zip(b["tbl"], b["doc"], strict=True):
                    fresh.append((t, d) not in seen)
                    seen.add((t, d))
                b = b[fresh]
                sets = [words.of(t) for t in b["content"]]
                keep = np.array([len(s) > 0 for s in sets], bool)
                if not keep.any():
                    continue
                tbl = np.array([xxhash.xxh32_intdigest(t) & 1 for t in b["tbl"]], np.int64)[keep]
                yield pd.DataFrame(anchor_rows(tbl, b["doc"].to_numpy(np.int64)[keep], [s for s in sets if s]))

    anchored = some.mapInPandas(rows, "key bigint, doc bigint, f1 bigint, f2 bigint, wide binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = staged(anchored.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(_compare_sorted, _FOUND))
    candidates = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1")
    if not hot.isEmpty():
        blocks = hot.groupBy("key").agg(F.max("block").alias("last"))
        cells = hot.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        cells = cells.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

        def cell(g: pd.DataFrame) -> pd.DataFrame:
            x, i, j = _matrix(g, ("key", "a", "f1", "f2")), g["i"].iat[0], g["j"].iat[0]
            at = g["block"].to_numpy()
            pairs = compare(x) if i == j else compare(x[at == i], x[at == j])
            return pd.DataFrame(pairs, columns=["a", "b"])

        candidates = candidates.unionByName(cells.groupBy("key", "i", "j").applyInPandas(cell, "a bigint, b bigint"))
    candidates = staged(candidates.distinct())
    wanted = candidates.select(F.col("a").alias("doc")).union(candidates.select("b")).distinct()
    content = staged(some.join(wanted, "doc", "left_semi").groupBy("tbl", "doc").agg(F.first("content").alias("content")))

    @F.pandas_udf("common int, together int")
    def overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(a), 2), np.int32)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            p, q = set(x.lower().split()), set(y.lower().split())
            c = len(p & q)
            out[i] = c, len(p) + len(q) - c
        return pd.DataFrame(out, columns=["common", "together"])

    both = candidates.join(content.select(F.col("doc").alias("a"), "tbl", F.col("content").alias("ca")), "a").join(content.select(F.col("doc").alias("b"), "tbl", F.col("content").alias("cb")), ["b", "tbl"])
    return both.select("tbl", "a", "b", overlap("ca", "cb").alias("o")).select("tbl", "a", "b", "o.common", "o.together").where(F.col("common") * DEN >= F.col("together") * NUM)


def _members(texts: DataFrame, seed: int) -> DataFrame:
    some = texts.where(F.col("id").isNotNull() & F.col("content").isNotNull() & F.col("content").rlike(r"(?U)\S"))
    return some.select("tbl", "id", text_key(seed).alias("doc"), F.xxhash64(F.lit("check"), "content").alias("check")).distinct()


def _first_ids(members: DataFrame) -> DataFrame:
    """tbl, doc, reps: the COPIES smallest ids of each class, n: its size, least: the smallest id, one: whether all its
    records have one text; in two steps, so that a class with a third of all rows is never collected."""
    part = members.groupBy("tbl", "doc", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("salt")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, COPIES).alias("r"), F.count(F.lit(1)).alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    whole = part.groupBy("tbl", "doc").agg(F.slice(F.sort_array(F.flatten(F.collect_list("r"))), 1, COPIES).alias("reps"), F.sum("n").alias("n"), (F.min("lo") == F.max("hi")).alias("one"))
    return whole.withColumn("least", F.col("reps")[0])


def _classes(texts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(members: tbl, id, doc; reps as in ``_first_ids``; the seed of the keys). Keys of which one stands for two
    texts (told by a second one) are made anew with another seed."""
    seed = 0
    while True:
        members = staged(_members(texts, seed))
        reps = staged(_first_ids(members))
        if reps.where("NOT one").isEmpty():
            return members.drop("check"), reps.drop("one"), seed
        seed += 1


def near_duplicate_pairs(texts: DataFrame) -> DataFrame:
    """tbl, id_a < id_b: records with at least 80 % of their words in common.

    ``texts``: tbl, id, content; rows may recur and count once. Null, empty and blank contents and
    null ids never count. Between different texts no link is lost: each record is paired with the
    first ``COPIES`` records of the other text. Within a class of equal texts each record is paired
    with the first ``COPIES`` ones, so a class of n records has at most COPIES * n pairs. Pairs of
    records that both stand behind the first ``COPIES``, of one text or of two linked ones, aren't given
    singly; ``near_duplicate_groups`` has both records in one group and counts the link in n_links.
    """
    members, reps, seed = _classes(texts)
    links = text_links(texts, seed).select("tbl", "a", "b")
    equal = members.join(reps.where("n > 1"), ["tbl", "doc"]).select("tbl", F.explode("reps").alias("x"), F.col("id").alias("y")).where("x < y")
    first = links.join(reps.select("tbl", F.col("doc").alias("b"), F.col("reps").alias("rb")), ["tbl", "b"]).join(members.select("tbl", F.col("doc").alias("a"), "id"), ["tbl", "a"])
    first = first.select("tbl", F.col("id").alias("x"), F.explode("rb").alias("y"))
    others = members.join(reps.where(f"n > {COPIES}"), ["tbl", "doc"]).where(~F.array_contains("reps", F.col("id"))).select("tbl", F.col("doc").alias("b"), "id")
    second = links.join(others, ["tbl", "b"]).join(reps.select("tbl", F.col("doc").alias("a"), F.col("reps").alias("ra")), ["tbl", "a"]).select("tbl", F.explode("ra").alias("x"), F.col("id").alias("y"))
    pairs = equal.unionByName(first).unionByName(second)
    return pairs.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(edges: DataFrame) -> DataFrame:
    """tbl, node, root (the smallest node of its component) for all nodes of edges (tbl, a, b).

    Alternating stars: every node's larger neighbours are hung on its smallest one, then its smaller ones; the
    number of rounds grows with the logarithm of the nodes, whatever the length of chains. Minima are
    taken by aggregates, so no node's neighbours are ever collected.
    """
    e = staged(edges.where("a <> b").select("tbl", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("tbl", "a", "b").cast("decimal(38,0)"))).first())

    before = state(e)
    while True:
        both = e.unionByName(e.select("tbl", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("tbl", "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, ["tbl", "a"]).where("b > a").select("tbl", F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large)
        low = large.groupBy("tbl", "a").agg(F.min("b").alias("m"))
        small = large.join(low, ["tbl", "a"]).select("tbl", F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("tbl", "x.a", "x.b")
        e = staged(small.where("a <> b").distinct())
        after = state(e)
        if after == before:
            break
        before = after
    roots = e.select("tbl", F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select("tbl", F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_duplicate_groups(texts: DataFrame) -> DataFrame:
    """One row a record: tbl, id, group_id (smallest id of its group), n_links (records linked to it,
    those with an equal text among them). Records without links are groups of their own."""
    members, sizes, seed = _classes(texts)
    links = staged(text_links(texts, seed).select("tbl", "a", "b"))
    both = links.union(links.select("tbl", "b", "a"))
    root = components(links).withColumnRenamed("node", "doc")
    label = sizes.select("tbl", "doc", "least").join(root, ["tbl", "doc"], "left").withColumn("root", F.coalesce("root", "doc"))
    label = staged(label)
    label = label.join(label.groupBy("tbl", "root").agg(F.min("least").alias("g")), ["tbl", "root"]).select("tbl", "doc", "g")
    linked = both.join(sizes.select("tbl", F.col("doc").alias("b"), "n"), ["tbl", "b"]).groupBy("tbl", F.col("a").alias("doc")).agg(F.sum("n").alias("m"))
    out = members.join(label, ["tbl", "doc"]).join(sizes.select("tbl", "doc", "n"), ["tbl", "doc"]).join(linked, ["tbl", "doc"], "left")
    return out.select("tbl", "id", F.col("g").alias("group_id"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
