"""Matching arriving documents against a static corpus (an extension; the reference is batch only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charterloom.operators.features import feature_counts
from charterloom.plans.materialize import materialize


def frequencies(weights: DataFrame) -> DataFrame:
    """(feature, df) of the corpus, one row a feature."""
    return weights.groupBy("feature").agg(F.first("df").alias("df"))


def match_arrivals(arrivals: DataFrame, weights: DataFrame, vocabulary: int, n: int, ngram: int = 6, n_out: int = 1, known: DataFrame | None = None) -> DataFrame:
    """(doc_idx, j, score) of each batch of encoded arrivals (doc_idx, ids) against corpus weights.

    ``weights`` are ``similarity.corpus_weights``: an arrival may share a
    feature with one corpus document only, which ``shared_weights`` leaves out.
    For use in ``foreachBatch``: document frequencies and norms of the corpus
    stay as they are, features it does not know count only in the arrival's
    norm with a frequency of zero.  ``known`` are the ``frequencies`` of the
    weights where they are at hand.
    """
    postings = feature_counts(arrivals.select("doc_idx", "ids"), vocabulary, ["doc_idx"], ngram, n_out)
    known = frequencies(weights) if known is None else known
    idf = F.log((1 + F.lit(n)) / (1 + F.coalesce("df", F.lit(0)))) + 1
    raw = postings.join(known, "feature", "left").select("doc_idx", "feature", (F.col("tf") * idf).alias("raw"), F.col("df").isNotNull().alias("known"))
    norms = raw.groupBy("doc_idx").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    mine = raw.where("known").join(norms, "doc_idx").select("doc_idx", "feature", (F.col("raw") / F.col("norm")).alias("wa"))
    other = weights.select("feature", F.col("doc_idx").alias("j"), F.col("w").alias("wb"))
    return mine.join(other, "feature").groupBy("doc_idx", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def start(arrivals: DataFrame, weights: DataFrame, vocabulary: int, n: int, path: str, checkpoint: str, ngram: int = 6, n_out: int = 1):
    """Stream encoded arrivals and append their matches to ``path``; a batch that is retried overwrites its own folder."""
    known = materialize(frequencies(weights), "frequencies")  # once, not for each batch

    def write(batch: DataFrame, number: int) -> None:
        match_arrivals(batch, weights, vocabulary, n, ngram, n_out, known).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
