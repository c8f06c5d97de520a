"""Mixing sources to target weights by a low-discrepancy schedule.

The sequence of the mix consists of slots of ``block_tokens`` tokens. Slot i has the point
frac(i * golden ratio), which falls into one source's stretch of the cumulative numbers of blocks: any
run of slots holds each source close to its share. The schedule is as long as it takes to give every
source a slot for each of its blocks; surplus slots stay empty. A source's documents, shuffled (once for each
repetition), are laid end to end and cut into blocks of equal tokens; its k-th slot takes its
k-th block.

Running sums and ranks are taken in two steps (sums per hash range, then within a range), so a
source with a third of all documents is no single task.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import staged

GOLDEN = (math.sqrt(5) - 1) / 2
#: Ranges that a source's shuffled documents are cut into for running sums.
RANGES = 256


def _running(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of ``group`` before this one, in the order (range, *order)."""
    parts = df.groupBy(group, "range").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(parts, [group, "range"]).withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_before")


def plan_mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row a source with its tokens in the mix: source, target_share, weight, docs, available,
    copies (repetitions at most), wanted.

    The mix is the largest in which all sources reach their shares: the source that its cap on
    repetitions limits most sets the total. A source without documents (or with empty ones
    only) can't contribute; the others' weights are its target shares scaled to sum 1. Sources
    without a target, and targets that are null or not positive, stay out. A null cap means 1.
    With ``total_tokens`` the mix has that size instead; a source that its cap limits then gives all
    it may, and falls short of its share.
    """
    have = sized.where(F.col("source").isNotNull() & (F.col("tokens") > 0)).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("available"))
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.greatest(F.lit(1), F.coalesce(F.max("max_repeats"), F.lit(1))).alias("cap"))
    both = t.join(have, "source", "left").withColumn("ok", (F.col("target_share") > 0) & F.col("available").isNotNull())
    every = Window.partitionBy()  # over the targets, one row a source of the mix
    both = both.withColumn("weight", F.when(F.col("ok"), F.col("target_share") / F.sum(F.when(F.col("ok"), F.col("target_share"))).over(every)).otherwise(0.0))
    both = both.withColumn("total", F.lit(total_tokens).cast("bigint") if total_tokens else F.min(F.when(F.col("ok"), F.floor(F.col("available") * F.col("cap") / F.col("weight")))).over(every))
    return both.select(
        "source",
        "target_share",
        "weight",
        F.coalesce("docs", F.lit(0)).alias("docs"),
        F.coalesce("available", F.lit(0)).alias("available"),
        F.col("cap").cast("int").alias("max_repeats"),
        F.coalesce(F.least(F.floor(F.col("weight") * F.col("total")), F.col("available") * F.col("cap")), F.lit(0)).cast("bigint").alias("wanted"),
    )


#: A block holds this part of the mix, within the bounds: fine enough for small mixes, and few enough slots.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 8192, 512, 1 << 20


def mix(sized: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, block_tokens: int | None = None, seed: int = 42) -> DataFrame:
    """The mix, one row a use of a document: slot, source, block, doc_id, copy, tokens.

    ``sized``: doc_id, source, tokens, each document once; null ids and sources and documents
    without tokens take no part. ``targets``: source, target_share, max_repeats. A document
    is used at most ``max_repeats`` times: its (n+1)-th use comes after all documents of the
    source were used n times. Empty tables give an empty mix. A document goes whole into the
    block where it starts.
    """
    spark = sized.sparkSession
    sized = sized.where(F.col("doc_id").isNotNull())
    plan = staged(plan_mix(sized, targets, total_tokens))
    # The targets are a table of settings: its rows are the sources of the mix, not of the corpus.
    rows = plan.where("wanted > 0").orderBy("source").collect()
    if block_tokens is None:
        block_tokens = min(MOST_BLOCK, max(LEAST_BLOCK, sum(r.wanted for r in rows) // BLOCKS))
    blocks = {r.source: math.ceil(r.wanted / block_tokens) for r in rows}
    slots = sum(blocks.values())
    point = (F.col("slot") * F.lit(GOLDEN)) % 1.0
    if rows:
        marks = F.array(*[F.lit(n / slots) for n in accumulate([0, *blocks.values()][:-1])])
        names = F.array(*[F.lit(s) for s in blocks])
        of = F.element_at(names, F.size(F.filter(marks, lambda e: e <= point)))
    else:
        of = F.lit(None).cast("string")

    def dealt(n: int) -> DataFrame:
        return spark.range(n).withColumnRenamed("id", "slot").withColumn("source", of)

    # Points near their shares aren't exactly there: the schedule goes on until no source lacks a slot.
    while rows:
        got = {r.source: r["count"] for r in dealt(slots).groupBy("source").count().collect()}
        if all(got.get(s, 0) >= n for s, n in blocks.items()):
            break
        slots += max(1, slots // 8)
    s = dealt(slots).withColumn("range", F.floor(F.col("slot") * RANGES / F.lit(max(1, slots))))
    s = _running(s.withColumn("one", F.lit(1)), "source", ["slot"], "one", "block").select("slot", "source", "block")

    d = sized.where("tokens > 0").join(F.broadcast(plan.where("wanted > 0").select("source", "available", "max_repeats", "wanted")), "source")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("max_repeats"), F.ceil(F.col("wanted") / F.col("available")).cast("int")))))
    d = d.withColumn("mixed", F.xxhash64(F.lit(seed), "copy", "doc_id"))
    d = d.withColumn("range", F.col("copy") * RANGES + F.pmod(F.shiftrightunsigned("mixed", 56), F.lit(RANGES)))
    d = _running(d, "source", ["mixed", "doc_id"], "tokens", "start").where("start < wanted")
    d = d.withColumn("block", F.floor(F.col("start") / block_tokens))
    return d.join(s, ["source", "block"]).select("slot", "source", "block", "doc_id", "copy", "tokens")


def mix_shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares reached: source, target_share, docs, tokens, max_copy, share."""
    used = mixed.groupBy("source").agg(F.count_distinct("doc_id").alias("docs"), F.sum("tokens").alias("tokens"), F.max("copy").alias("max_copy"))
    plan = plan_mix(sized, targets).select("source", "target_share")
    every = Window.partitionBy()
    out = plan.join(used, "source", "left").select("source", "target_share", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("max_copy", F.lit(0)).alias("max_copy"))
    return out.withColumn("share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0)), F.lit(0.0)))
