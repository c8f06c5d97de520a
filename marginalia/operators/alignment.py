"""Whether cited references fit their evidence: pairs, hard negatives, score diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import squeeze, tokens
from marginalia.operators.bibliography import stem
from marginalia.operators.running import running

# Thresholds of a pair scorer that gives logits; for shares of words there are those of the second list.
THRESHOLDS = [-3.0, -2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]
SHARE_THRESHOLDS = [0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5]


def lexical_alignment(evidence: Column, reference: Column) -> Column:
    """Stand-in of a cross-encoder's score: common share of the texts' distinct tokens."""
    a, b = F.array_distinct(tokens(evidence)), F.array_distinct(tokens(reference))
    return F.round(F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0)), 6)


def usable_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence with content, source and page, and with a citation; equal ones once (the lowest id)."""
    e = evidence.where("content IS NOT NULL AND content <> '' AND source IS NOT NULL AND source <> '' AND page_number IS NOT NULL AND size(reference_numbers) > 0")
    key = ["source", "page_number", squeeze(F.col("content")), F.to_json("reference_numbers")]
    w = Window.partitionBy(*key).orderBy("ev_id")
    return e.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def align_pairs(evidence: DataFrame, refs: DataFrame, score=lexical_alignment) -> DataFrame:  # noqa: ANN001
    """Scores of (evidence, cited reference): ev_id, pos, source, number, score; missing ones left out."""
    e = evidence.select("ev_id", "source", F.col("content").alias("evidence_text"), F.posexplode(F.array_distinct(F.array_compact("reference_numbers"))).alias("pos", "number"))
    r = refs.select("source", "number", F.col("content").alias("reference_text"))
    return e.join(r, ["source", "number"]).select("ev_id", "pos", "source", "number", score(F.col("evidence_text"), F.col("reference_text")).alias("score"))


def score_references(asked: DataFrame, references: DataFrame, score=lexical_alignment) -> DataFrame:  # noqa: ANN001
    """``asked`` (ask_id, evidence_text, source, number) with reference_text and score, null where the store has no such
    reference or an empty one. One join for all; references: stem, number, content."""
    r = references.where("content <> ''").select(F.col("stem").alias("_stem"), F.col("number").alias("_number"), F.col("content").alias("reference_text"))
    j = asked.join(r, (stem(F.col("source")) == F.col("_stem")) & (F.col("number") == F.col("_number")), "left").drop("_stem", "_number")
    return j.withColumn("score", F.when(F.col("reference_text").isNotNull(), score(F.col("evidence_text"), F.col("reference_text"))))


def hard_negatives(evidence: DataFrame, refs: DataFrame, per_evidence: int = 2) -> DataFrame:
    """ev_id, source, number, place: references of the source that the evidence doesn't cite, nearest in
    number to the first cited one, ties to the lower.

    A source's references are first ranked by number, and only those within reach of the anchor are
    met: the neighbours on either side that could still be among the nearest uncited ones.
    """
    anchor = F.array_compact("reference_numbers")
    e = evidence.select("ev_id", "source", F.array_distinct(anchor).alias("cited")).where(F.size("cited") > 0).withColumn("anchor", F.col("cited")[0])
    r = refs.where("number IS NOT NULL AND source IS NOT NULL").select("source", "number").distinct()
    # Numbers and anchors in one order: how many numbers stand before each, counted in two steps.
    points = r.withColumn("is_ref", F.lit(1)).unionByName(e.select("source", F.col("anchor").alias("number")).distinct().withColumn("is_ref", F.lit(0)))
    counted = running(points, {"before": ("sum", F.col("is_ref"))}, ("number", "is_ref"), inclusive=False)
    r = counted.where("is_ref = 1").select("source", "number", (F.col("before") + 1).alias("place"))
    at = counted.where("is_ref = 0").select("source", F.col("number").alias("anchor"), "before")
    e = e.join(at, ["source", "anchor"])
    reach = F.size("cited") + per_evidence
    e = e.withColumn("place", F.explode(F.sequence(F.greatest(F.lit(1), F.col("before") - reach + 1).cast("int"), (F.col("before") + reach + 1).cast("int"))))
    c = e.join(r, ["source", "place"]).where(~F.array_contains("cited", F.col("number")))
    w = Window.partitionBy("ev_id").orderBy(F.abs(F.col("number") - F.col("anchor")), "number")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_evidence).select("ev_id", "source", "number", "rank")


def score_summary(scores: DataFrame) -> DataFrame:
    """count, min, P10, P25, median, mean, P75, P90, max of score by type, with linear interpolation."""
    s = F.col("score")
    return scores.groupBy("type").agg(
        F.count(s).alias("n"), F.min(s).alias("min"), *[F.round(F.percentile(s, F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)], F.round(F.avg(s), 6).alias("mean"), F.max(s).alias("max")
    )


def threshold_diagnostics(scores: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """At each threshold the share of cited pairs at or above it, and of negative pairs below it."""
    s, cited, negative = F.col("score"), F.col("type") == "cited", F.col("type") == "negative"
    row = scores.agg(
        *[F.struct(F.lit(t).alias("threshold"), F.round(F.coalesce(F.avg(F.when(cited, (s >= t).cast("double"))), F.lit(0.0)), 6).alias("cited_kept"), F.round(F.coalesce(F.avg(F.when(negative, (s < t).cast("double"))), F.lit(0.0)), 6).alias("negative_rejected")).alias(f"t{i}") for i, t in enumerate(thresholds)]
    )
    return row.select(F.explode(F.array(*row.columns)).alias("r")).select("r.*")


def extremes(scores: DataFrame, n: int = 15) -> DataFrame:
    """The n lowest cited pairs and the n highest negative ones."""
    low = scores.where("type = 'cited'").orderBy("score", "ev_id", "number").limit(n)
    high = scores.where("type = 'negative'").orderBy(F.desc("score"), "ev_id", "number").limit(n)
    return low.unionByName(high)
