"""Choosing the similarity cutoff from the stored scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EMPTY_THRESHOLD = 0.01
BINS = 256


def stored_pairs(dist_mat: DataFrame) -> DataFrame:
    """(i, j, score), i <= j: one row per pair of a similarity table.

    Rows with null ids or a score that is null or not a number are left out;
    of several scores of a pair the latest holds (null times first, then the
    greater score).
    """
    score = F.col("score").cast("double")
    good = dist_mat.where(F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    latest = F.max(F.struct(F.col("scored_at").isNotNull(), "scored_at", score.alias("s")))
    rows = good.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "scored_at", "score")
    return rows.groupBy("i", "j").agg(latest.alias("x")).select("i", "j", F.col("x.s").alias("score"))


def weighted_scores(pairs: DataFrame, documents: int = 0) -> DataFrame:
    """(score, weight) as a symmetric matrix stores them: pairs twice, the diagonal once.

    ``documents`` adds that many diagonal entries of 1.0 for pairs that hold
    no diagonal of their own.
    """
    rows = pairs.select("score", F.when(F.col("i") == F.col("j"), 1).otherwise(2).cast("bigint").alias("weight"))
    if documents:
        rows = rows.unionByName(pairs.sparkSession.createDataFrame([(1.0, documents)], "score double, weight bigint"))
    return rows


def otsu(scores: DataFrame, bins: int = BINS) -> DataFrame:
    """(threshold): centre of the bin that parts the weighted histogram best; the score itself if there is only one, 0.01 without scores.

    Only the histogram leaves the aggregation, ``bins`` rows.
    """
    limits = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if limits["lo"] is None:
        return scores.sparkSession.createDataFrame([(EMPTY_THRESHOLD,)], "threshold double")
    lo, hi = limits
    if lo == hi:
        return scores.sparkSession.createDataFrame([(float(lo),)], "threshold double")
    place = F.least(F.floor((F.col("score") - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
    counts = scores.groupBy(place.alias("bin")).agg(F.sum("weight").alias("c"))
    full = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left")
    centre = F.lit(lo) + (F.col("bin") + 0.5) * F.lit((hi - lo) / bins)
    full = full.select("bin", centre.alias("centre"), F.coalesce("c", F.lit(0)).cast("double").alias("c"))
    upto, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    run = full.select("bin", "centre", F.sum("c").over(upto).alias("w1"), F.sum(F.col("c") * F.col("centre")).over(upto).alias("s1"), F.sum("c").over(every).alias("n"), F.sum(F.col("c") * F.col("centre")).over(every).alias("s"))
    gap = F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / (F.col("n") - F.col("w1"))
    spread = F.col("w1") * (F.col("n") - F.col("w1")) * gap * gap
    cut = run.where((F.col("bin") < bins - 1) & (F.col("w1") > 0) & (F.col("w1") < F.col("n")))
    return cut.agg(F.max_by("centre", F.struct(F.round(spread, 9), -F.col("bin"))).alias("threshold"))


def percentile(scores: DataFrame, share: float = 0.99) -> DataFrame:
    """(threshold): the weighted percentile with linear interpolation, 0.01 without scores."""
    return scores.agg(F.coalesce(F.percentile("score", F.lit(share), F.col("weight")), F.lit(EMPTY_THRESHOLD)).alias("threshold"))


def choose(scores: DataFrame, setting: str = "auto", method: str = "otsu") -> float:
    """The cutoff as a number: a fixed one, or the automatic one by the method."""
    if str(setting) != "auto":
        return float(setting)
    if method not in ("otsu", "percentile"):
        raise ValueError(f"unknown auto_threshold_method {method!r}")
    return float((otsu if method == "otsu" else percentile)(scores).first()[0])
