"""References to records that do not exist, by range-partitioned sorted parent arrays.

The keys (source, number) are mapped to 64-bit codes that spread evenly, and the codes are cut into
ranges of equal width, as many as the parents need. Per range the parents are stored as arrays sorted by
(key, start of life) together with the running latest end of life. Batches of references are
sent to their range and looked up with vectorised binary searches; a second code tells keys of one code apart.

Hot keys: a range with very many references is split by a salt, and its parents are copied to each salt. A
range with very many parents (one key with very many records) is split into parts, its references meet each
part, and a reference is live if it is so in any of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import staged

NEVER = np.iinfo(np.int64).max


def source_key(c: Column) -> Column:
    """Sources agree without outer spaces, letter case and a final ``.pdf``."""
    s = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(s, r"\.pdf$", "")


def _key(source: Column, number: Column) -> Column:
    return F.xxhash64(source_key(source), number.cast("int"))


def _check(source: Column, number: Column) -> Column:
    return F.xxhash64(F.lit("check"), number.cast("int"), source_key(source))


def _bisect(starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each i the number of entries of starts[lo[i]:hi[i]] that are <= t[i], plus lo[i]."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        live = lo < hi
        if not live.any():
            return lo
        mid = (lo + hi) >> 1
        up = live & (starts[np.minimum(mid, len(starts) - 1)] <= t)
        lo = np.where(up, mid + 1, lo)
        hi = np.where(live & ~up, mid, hi)


def probe(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, pk: np.ndarray, pt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known, live) of each reference ``(pk, pt)``: whether the key exists at all, and whether one
    of its records has start <= pt < end. ``keys`` sorted, ``starts`` sorted within a key, ``ends``
    the running maximum of the ends within a key."""
    lo, hi = np.searchsorted(keys, pk, "left"), np.searchsorted(keys, pk, "right")
    at = _bisect(starts, lo, hi, pt) - 1
    has = at >= lo
    live = has & (ends[np.maximum(at, 0)] > pt) if len(keys) else np.zeros(len(pk), bool)
    return hi > lo, live


def _told_apart(key: np.ndarray, check: np.ndarray, pk: np.ndarray, pcheck: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of parents and references such that equal ones agree in both codes."""
    o = np.lexsort((check, key))
    k, c = key[o], check[o]
    at = np.minimum(np.searchsorted(k, pk), max(0, len(k) - 1))
    clear = not ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any() and (not len(k) or not ((k[at] == pk) & (c[at] != pcheck)).any())
    if clear:
        return key, pk
    both = np.empty(len(key) + len(pk), [("k", np.int64), ("c", np.int64)])
    both["k"], both["c"] = np.r_[key, pk], np.r_[check, pcheck]
    number = np.unique(both, return_inverse=True)[1].reshape(-1).astype(np.int64)
    return number[: len(key)], number[len(key) :]


def _sorted_arrays(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    o = np.lexsort((start, key))
    key, start, end = key[o], start[o], end[o].copy()
    # Running maximum within a key: a doubling scan, so no Python loop runs over the entries.
    step = 1
    longest = int(np.max(np.diff(np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])))) if len(key) else 0
    while step < longest:
        same = key[step:] == key[:-step]
        end[step:] = np.where(same, np.maximum(end[step:], end[:-step]), end[step:])
        step *= 2
    return key, start, end


def orphan_references(
    refs: DataFrame,
    probes: DataFrame,
    *,
    parents_per_range: int = 100_000,
    probes_per_task: int = 200_000,
    keep_live: bool = False,
) -> DataFrame:
    """References without a live parent.

    ``refs``: source, number, ingested_at, deleted_at. ``probes``: ref_table, row_id, source,
    ref_number, at. Result: ref_table, row_id, ref_number, at, reason (``missing``: the key never
    existed; ``not_live``: it exists, but not at that time), with ``keep_live`` also the others
    (reason null).

    Nulls: a probe without source or number is no reference. A parent without source, number or
    ingested_at is never live. A reference without a time has no live parent. Repeated rows are
    probed repeatedly; callers deduplicate. Empty tables give the natural result (all orphans,
    or none). Extra columns of either input are ignored.
    """
    # Ranges grow with the parents; at least two, so that a range is never one constant.
    bits = min(30, max(1, int(np.ceil(np.log2(max(1, refs.count()) / parents_per_range)))))
    rng = F.shiftrightunsigned(F.col("key"), 64 - bits).cast("int")

    parents = (
        refs.where(F.col("source").isNotNull() & F.col("number").isNotNull() & F.col("ingested_at").isNotNull())
        .select(
            _key(F.col("source"), F.col("number")).alias("key"),
            _check(F.col("source"), F.col("number")).alias("check"),
            F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("start"),
            F.coalesce(F.unix_micros(F.col("deleted_at").cast("timestamp")), F.lit(int(NEVER))).alias("end"),
        )
        # A key's lifetimes that start together live as long as the longest of them.
        .groupBy("key", "check", "start").agg(F.max("end").alias("end"))
        .withColumn("range", rng)
    )
    p = (
        probes.where(F.col("source").isNotNull() & F.col("ref_number").isNotNull())
        .select("ref_table", "row_id", F.col("ref_number").cast("int").alias("ref_number"), F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), _key(F.col("source"), F.col("ref_number")).alias("key"), _check(F.col("source"), F.col("ref_number")).alias("check"))
        .withColumn("range", rng)
    )
    # One row a range: how often its references and its parents are split.
    size = p.groupBy("range").agg(F.count(F.lit(1)).alias("refs")).join(parents.groupBy("range").agg(F.count(F.lit(1)).alias("parents")), "range", "left")
    size = staged(size.select("range", F.ceil(F.col("refs") / probes_per_task).cast("int").alias("salts"), F.greatest(F.lit(1), F.ceil(F.coalesce("parents", F.lit(0)) / (4 * parents_per_range))).cast("int").alias("parts")))
    split = not size.where("parts > 1").isEmpty()
    p = p.join(size, "range").withColumn("salt", F.pmod(F.xxhash64("row_id", "ref_number"), F.col("salts")).cast("int"))
    p = p.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if split else F.lit(0))
    parents = parents.join(size, "range").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    parents = parents.withColumn("part", F.pmod(F.xxhash64("start"), F.col("parts")).cast("int"))

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[["ref_table", "row_id", "ref_number", "at_us"]].copy()
        key, pk = _told_apart(*[x.to_numpy(np.int64) for x in (right["key"], right["check"], left["key"], left["check"])])
        keys, starts, ends = _sorted_arrays(key, right["start"].to_numpy(np.int64), right["end"].to_numpy(np.int64))
        t = left["at_us"].fillna(np.iinfo(np.int64).min).to_numpy(np.int64) if len(left) else np.empty(0, np.int64)
        out["known"], out["live"] = probe(keys, starts, ends, pk, t)
        return out if keep_live or split else out[~out["live"]]

    columns = ["ref_table", "row_id", "ref_number", "at_us", "key", "check", "range", "salt", "part"]
    out = p.select(*columns).groupBy("range", "salt", "part").cogroup(parents.select("key", "check", "start", "end", "range", "salt", "part").groupBy("range", "salt", "part")).applyInPandas(one, "ref_table string, row_id bigint, ref_number int, at_us bigint, known boolean, live boolean")
    if split:
        # What met several parts: live or known in any of them. Repeated references stay as often as they came.
        met = out.groupBy("ref_table", "row_id", "ref_number", "at_us").agg(F.bool_or("known").alias("known"), F.bool_or("live").alias("live"))
        times = p.where("part = 0").groupBy("ref_table", "row_id", "ref_number", "at_us").agg(F.count(F.lit(1)).alias("times"))
        same = [F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("ref_table", "row_id", "ref_number", "at_us")]
        out = met.alias("m").join(times.alias("t"), same).select("m.*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")
        out = out if keep_live else out.where("NOT live")
    reason = F.when(~F.col("live"), F.when(F.col("known"), "not_live").otherwise("missing"))
    return out.select("ref_table", "row_id", "ref_number", F.timestamp_micros("at_us").cast("timestamp_ntz").alias("at"), reason.alias("reason"))


def reference_probes(evidence: DataFrame, used_refs: DataFrame) -> DataFrame:
    """The references of both tables as ``orphan_references`` takes them, each once per record."""
    ev = evidence.select(
        F.lit("evidence").alias("ref_table"),
        F.col("ev_id").alias("row_id"),
        "source",
        F.explode(F.array_distinct("reference_numbers")).alias("ref_number"),
        F.col("created_at").alias("at"),
    )
    us = used_refs.select(F.lit("used_refs").alias("ref_table"), F.col("use_id").alias("row_id"), "source", F.col("number").alias("ref_number"), F.col("used_at").alias("at"))
    return ev.unionByName(us).where(F.col("source").isNotNull() & F.col("ref_number").isNotNull()).distinct()


def orphan_report(orphans_and_live: DataFrame) -> DataFrame:
    """Per table and month: references, orphans, and of those the keys that never existed."""
    return (
        orphans_and_live.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("n_refs"),
            F.count("reason").alias("n_orphans"),
            F.count_if(F.col("reason") == "missing").alias("n_missing"),
        )
    )
