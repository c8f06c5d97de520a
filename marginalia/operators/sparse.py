"""BM25 over a corpus: an index that is stored once, and all queries in one plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import strip, tokens
from marginalia.session import staged

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents and tokens of a stored block at most (one document may have more tokens; places in a block have 16 bits).
BLOCK, BLOCK_TOKENS = 16_384, 4_000_000
#: Documents and postings that a task searches at once.
TOGETHER, TOGETHER_POSTINGS = 131_072, 16_000_000
#: Queries of a batch, at most and, while there are cores without one, at least.
QUERIES, FEW_QUERIES = 8192, 512
#: Bytes of frequent terms' parts that a task holds by document.
DENSE = 64_000_000
#: Documents whose best one is taken together, and the most documents of a query that are scored again one by one.
GROUP, FEW = 64, 1024


@dataclass(frozen=True)
class Index:
    """A corpus as tables: blocks (documents and their postings by term, as arrays), terms (term, df, idf), and two
    numbers. Blocks are stored, so queries don't take texts apart again."""

    blocks: DataFrame
    terms: DataFrame
    n: int
    avglen: float


def _texts(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("doc").isNotNull() & F.col("content").isNotNull() & (strip(F.col("content")) != ""))


def postings(corpus: DataFrame) -> DataFrame:
    """term, doc, tf, len of a corpus (doc, content); blank contents are no documents."""
    t = _texts(corpus).select("doc", tokens(F.col("content")).alias("t"))
    return t.select("doc", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _idf(df: DataFrame, n: int) -> DataFrame:
    """term, df, idf: ln((n - df + 0.5) / (df + 0.5)); negative ones are replaced by a quarter of the
    mean over the whole vocabulary."""
    raw = staged(df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw")).first()[0]
    return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean if mean is not None else 0.0)).otherwise(F.col("raw")).alias("idf"))


def _gathered(batches: Iterator[pa.RecordBatch], most: int, most_tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Ids, numbers of tokens, and tokens of rows (id, tokens), as many rows at a time as both bounds allow."""
    ids, sizes, flat, n, size = [], [], [], 0, 0
    for b in batches:
        own, each = b.column(0).to_numpy(), pc.list_value_length(b.column(1)).to_numpy()
        ends, at = np.concatenate([[0], np.cumsum(each, dtype=np.int64)]), 0
        while at < len(each):
            to = min(int(np.searchsorted(ends, ends[at] + most_tokens - size, "right")) - 1, at + most - n)
            to = max(to, at + (n == 0))
            ids.append(own[at:to])
            sizes.append(each[at:to])
            flat.append(b.column(1).slice(at, to - at).flatten())
            n, size = n + to - at, size + int(ends[to] - ends[at])
            if to < len(each):
                yield np.concatenate(ids), np.concatenate(sizes), pa.concat_arrays(flat)
                ids, sizes, flat, n, size = [], [], [], 0, 0
            at = to
    if n:
        yield np.concatenate(ids), np.concatenate(sizes), pa.concat_arrays(flat)


def _strings(x: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _counted(each: np.ndarray, flat: pa.Array, by_term: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, and of each pair of term and row the term, the row and the count, in the order of either."""
    coded = flat.dictionary_encode()
    term, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(each)), each)
    width = max(1, len(each) if by_term else len(coded.dictionary))
    key, count = np.unique(term * width + row if by_term else row * width + term, return_counts=True)
    a, b = key // width, key % width
    return coded.dictionary, a if by_term else b, b if by_term else a, count


_BLOCK = "docs binary, lens binary, terms array<string>, df array<int>, at binary, tf binary, n int, total bigint"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (doc, tokens). Postings are in the order of terms, within a term in that of documents."""
    for docs, each, flat in _gathered(batches, BLOCK, BLOCK_TOKENS):
        terms, term, at, tf = _counted(each, flat, True)
        df = pa.array(np.bincount(term, minlength=len(terms)).astype(np.int32))
        arrays = [[docs.astype(np.int64).tobytes()], [each.astype(np.int32).tobytes()], _strings(terms), _strings(df), [at.astype(np.uint16).tobytes()], [tf.astype(np.int32).tobytes()], pa.array([len(docs)], pa.int32()), pa.array([len(flat)], pa.int64())]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.binary()) for x in arrays], [x.split()[0] for x in _BLOCK.split(", ")])


def build_index(corpus: DataFrame) -> Index:
    """The index of a corpus (doc, content), each document once. Null docs and blank contents have no part in it."""
    blocks = staged(_texts(corpus).select(F.col("doc").cast("bigint").alias("doc"), tokens(F.col("content")).alias("t")).mapInArrow(_blocks, _BLOCK))
    n, total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    each = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    return Index(blocks, _idf(each.groupBy("term").agg(F.sum("df").alias("df")), n), n, total / n if n else 0.0)


_BATCH = "batch string, ids binary, asked array<string>, ends binary, which binary, times binary"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of queries (query_id, tokens): their terms, and of each query its terms and how often each occurs."""
    import uuid

    for ids, each, flat in _gathered(batches, 2 * QUERIES, BLOCK_TOKENS):
        terms, which, row, times = _counted(each, flat, False)
        ends = np.cumsum(np.bincount(row, minlength=len(ids)))
        arrays = [pa.array([uuid.uuid4().hex]), [ids.astype(np.int64).tobytes()], _strings(terms), [ends.astype(np.int64).tobytes()], [which.astype(np.int64).tobytes()], [times.astype(np.float64).tobytes()]]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.binary()) for x in arrays], [x.split()[0] for x in _BATCH.split(", ")])


class _Postings:
    """The postings of a batch's terms in some blocks, by term, with each one's part of a score but for the query's
    weight. Frequent terms also have their parts by document."""

    def __init__(self, asked: pa.Array, blocks: list[dict], avglen: float) -> None:
        self.docs = np.concatenate([x["docs"] for x in blocks])
        self.lens = np.concatenate([x["lens"] for x in blocks])
        self.avglen = avglen
        known = []
        for x in blocks:
            place = pc.fill_null(pc.index_in(x["terms"], value_set=asked), -1).to_numpy().astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(x["df"])])[:-1]
            here = np.flatnonzero(place >= 0)
            known.append((place[here], starts[here], x["df"][here].astype(np.int64)))
        self.df = np.zeros(len(asked), np.int64)
        for place, _, size in known:
            self.df[place] += size
        self.ends = np.cumsum(self.df)
        self.starts = self.ends - self.df
        free, base = self.starts.copy(), 0
        small = np.min_scalar_type(max((int(x["tf"].max()) for x in blocks if len(x["tf"])), default=0))
        self.at, self.tf, self.part = (np.empty(int(self.df.sum()), t) for t in (np.int32, small, np.float32))
        for x, (place, start, size) in zip(blocks, known, strict=True):
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            to, frm = np.repeat(free[place], size) + step, np.repeat(start, size) + step
            self.at[to], self.tf[to] = x["at"][frm].astype(np.int32) + base, x["tf"][frm]
            self.part[to] = self._part(self.tf[to], self.at[to])
            free[place] += size
            base += len(x["docs"])
        self.most = np.zeros(len(asked))
        some = np.flatnonzero(self.df)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.part, self.starts[some])
        self.width = -(-len(self.docs) // GROUP) * GROUP
        frequent = np.argsort(-self.df, kind="stable")[: DENSE // (4 * self.width)]
        frequent = frequent[self.df[frequent] > self.width / 24]
        self.row = np.full(len(asked), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.width), np.float32)
        for i, t in enumerate(frequent):
            own = slice(self.starts[t], self.ends[t])
            self.dense[i, self.at[own]] = self.part[own]

    def _part(self, tf: np.ndarray, at: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.float64)
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.lens[at] / (self.avglen or 1.0)))

    def sums(self, terms: np.ndarray, weights: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Scores of all documents, to the precision of ``out``."""
        out.fill(0)
        single = out.dtype == np.float32
        for t, w in zip(terms.tolist(), weights.astype(out.dtype), strict=True):
            if single and self.row[t] >= 0:
                out += self.dense[self.row[t]] * w
            elif self.df[t]:
                own = slice(self.starts[t], self.ends[t])
                np.add.at(out, self.at[own], (self.part[own] if single else self._part(self.tf[own], self.at[own])) * w)
        return out

    def exact(self, query: np.ndarray, at: np.ndarray, ends: np.ndarray, which: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of pairs of query and document, rounded."""
        score = np.zeros(len(query))
        if not len(self.at):
            return score
        starts = np.concatenate([[0], ends[:-1]])
        for i in range(0, len(query), 16_384):
            q, d = query[i : i + 16_384], at[i : i + 16_384]
            size = ends[q] - starts[q]
            pair = np.repeat(np.arange(len(q)), size)
            of = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[q], size)
            doc, low, high = d[pair], self.starts[which[of]], self.ends[which[of]]
            last = high
            while (low < high).any():  # where the document would be among its term's, all at once
                mid = (low + high) // 2
                below = (low < high) & (self.at[np.minimum(mid, len(self.at) - 1)] < doc)
                low, high = np.where(below, mid + 1, low), np.where(below, high, np.minimum(mid, high))
            place = np.minimum(low, len(self.at) - 1)
            hit = (low < last) & (self.at[place] == doc)
            score[i : i + 16_384] = np.bincount(pair[hit], self._part(self.tf[place[hit]], d[pair[hit]]) * weights[of[hit]], len(q))
        return np.round(score, 6)


def _first(score: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by the lower doc."""
    if len(score) > k:
        least = np.partition(score, -k)[-k]
        above, same = np.flatnonzero(score > least), np.flatnonzero(score == least)
        return np.concatenate([above, same[np.argsort(docs[same])[: k - len(above)]]])
    return np.arange(len(score))


def _search(ids: np.ndarray, ends: np.ndarray, which: np.ndarray, weights: np.ndarray, p: _Postings, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, docs and scores: the k best documents of each query. Sums in single precision leave few documents,
    which are scored again; where they leave many, all are."""
    n, k = len(p.docs), min(k, len(p.docs))
    sums, query, at = np.empty(p.width, np.float32), [], []
    start = 0
    for i, end in enumerate(ends.tolist()):
        terms, w = which[start:end], weights[start:end]
        start = end
        p.sums(terms, w, sums)
        off = 2e-6 + 4e-6 * float(np.abs(w) @ p.most[terms])  # more than single precision and rounding can change
        c = np.arange(n)
        if p.width // GROUP > k:
            # The k-th best of the groups' best is no better than the k-th best of all (places behind the last document are 0).
            best = sums.reshape(-1, GROUP).max(1)
            best[-1] = sums[p.width - GROUP : n].max()
            c = np.flatnonzero(sums[:n] >= np.partition(best, -k)[-k] - off)
        if len(c) > k:
            c = c[sums[c] >= np.partition(sums[c], -k)[-k] - off]
        if len(c) > FEW:
            s = np.round(p.sums(terms, w, np.empty(p.width))[:n], 6)
            c = _first(s, p.docs, k)
        query.append(np.full(len(c), i))
        at.append(c)
    query, at = np.concatenate(query), np.concatenate(at)
    score = p.exact(query, at, ends, which, weights)
    order = np.lexsort((p.docs[at], -score, query))
    query, at, score = query[order], at[order], score[order]
    new = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
    first = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0)) < k
    yield ids[query[first]], p.docs[at[first]], score[first]


def _array(b: pa.RecordBatch, name: str, i: int, dtype: type) -> np.ndarray:
    return np.frombuffer(b.column(name)[i].as_buffer(), dtype)


def _searched(avglen: float, k: int):  # noqa: ANN202
    """For rows of a batch and a block: query_id, doc, score, the k best of a batch's queries in the blocks searched at once."""

    def found(batch: tuple, blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        ids, asked, ends, which, weights = batch
        for q, d, s in _search(ids, ends, which, weights, _Postings(asked, blocks, avglen), k):
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(d), pa.array(s)], ["query_id", "doc", "score"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, batch, blocks, n, size = None, None, [], 0, 0
        for b in rows:
            for i, own in enumerate(b.column("batch").to_pylist()):
                docs, at = _array(b, "docs", i, np.int64), _array(b, "at", i, np.uint16)
                if blocks and (own != name or n + len(docs) > TOGETHER or size + len(at) > TOGETHER_POSTINGS):
                    yield from found(batch, blocks)
                    blocks, n, size = [], 0, 0
                if own != name:
                    asked, idf = b.column("asked")[i].values, np.zeros(len(b.column("asked")[i]))
                    if b.column("has")[i].is_valid:
                        idf[b.column("has")[i].values.to_numpy()] = b.column("idf")[i].values.to_numpy()
                    which = _array(b, "which", i, np.int64)
                    name, batch = own, (_array(b, "ids", i, np.int64), asked, _array(b, "ends", i, np.int64), which, _array(b, "times", i, np.float64) * idf[which])
                blocks.append({"docs": docs, "at": at, "lens": _array(b, "lens", i, np.int32), "tf": _array(b, "tf", i, np.int32), "terms": b.column("terms")[i].values, "df": b.column("df")[i].values.to_numpy()})
                n, size = n + len(docs), size + len(at)
        if blocks:
            yield from found(batch, blocks)

    return run


def bm25_topk(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc, score: the k best documents of each query.

    queries: query_id, text, each query once. Every token of a query counts as often as it occurs; unknown ones add
    nothing. Documents without any score fill up to k. Ties go to the lower doc. A blank query, or one
    without tokens, has no result. Batches of queries meet blocks of the index, which are read again for each batch
    instead of being exchanged: a task adds up the scores of its documents for one query after the other. The work
    is in proportion to the postings of all queries' terms; k rows a query and ``TOGETHER`` documents are exchanged.
    """
    spark = queries.sparkSession
    asked = queries.where("text IS NOT NULL AND query_id IS NOT NULL").select(F.col("query_id").cast("bigint").alias("query_id"), tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    n = asked.count()
    parts = max(1, -(-n // QUERIES), min(spark.sparkContext.defaultParallelism, -(-n // FEW_QUERIES)))
    batches = staged(asked.repartition(parts, "query_id").mapInArrow(_batches, _BATCH))
    known = batches.select("batch", F.posexplode("asked").alias("i", "term")).join(index.terms.select("term", "idf"), "term")
    idf = known.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("i", "idf"))).alias("x")).select("batch", F.col("x.i").alias("has"), F.col("x.idf").alias("idf"))
    pairs = batches.join(idf, "batch", "left").repartitionByRange(parts, "batch").hint("shuffle_replicate_nl").crossJoin(index.blocks.drop("n", "total").coalesce(max(1, -(-index.n // TOGETHER))))
    scored = pairs.mapInArrow(_searched(index.avglen, k), "query_id bigint, doc bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc", "score")
