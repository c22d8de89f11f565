"""How distinctive a term is for its record (problem 3).

Divergence from randomness with a geometric model of the collection: with
F occurrences of a term in N records, lambda = F / N, and the
length-normalised frequency tfn = tf * log2(1 + mean length / length), the
information content is -log2(1 / (1 + lambda)) - tfn * log2(lambda / (1 + lambda)),
and the score multiplies it by the Laplace after-effect gain 1 / (tfn + 1).

Totals of terms join back to the records in two ways.  Terms that stand in
more than one of ``HEAVY_PART`` records are at most HEAVY_PART * (mean number
of distinct terms per record), whatever the size of the collection, so their
totals are broadcast; each of the other terms has at most n / HEAVY_PART rows,
and their join shuffles without a hot key.

The cases of ``weighty_terms`` are defined by another measure, tf-idf with
norm 1.  The score picks the candidates by a proven bound, and an exact check
of the definition follows: a case has tf * idf >= minimum * norm, and the norm
is at least the root of the sum of tf^2, as no idf is below 1.  So tf is at
least minimum * sqrt(sum of tf^2) / idf, and where lambda <= 1 the score never
falls with tfn; hence a case scores at least what its term would at that
frequency.  Where lambda > 1 every term is a candidate.  No case is lost.

Null and empty elements are no terms and do not count towards lengths.
Repeated rows of a record count once.  Records without terms have no rows but
count among the records.  Equal scores are all kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charterloom.llm.frequency import n_records, record_terms, records, term_totals
from charterloom.plans.materialize import materialize

HEAVY_PART = 40
MIN_WEIGHT = 0.3
#: Totals of so many terms a partition may be hashed in memory.
HASHED_ROWS = 1_000_000


def _information(rate: Column, tfn: Column) -> Column:
    return (F.log2(1 + rate) - tfn * F.log2(rate / (1 + rate))) / (tfn + 1)


def _with_totals(tokenized: DataFrame) -> tuple[DataFrame, int, float]:
    """(doc_idx, token, tf, doc_len, squares, n_occurrences, n_records) of every term of every record, the number of records and the mean length."""
    n = n_records(tokenized)
    terms = materialize(record_terms(records(tokenized)), "terms")
    totals = materialize(term_totals(terms), "totals")
    mean = (totals.agg(F.sum("n_occurrences")).first()[0] or 0) / max(n, 1)
    heavy = totals.where(F.col("n_records") * HEAVY_PART > n)
    light = totals.where(F.col("n_records") * HEAVY_PART <= n)
    columns = ["doc_idx", "token", "tf", "doc_len", "squares", "n_occurrences", "n_records"]
    known = terms.join(F.broadcast(heavy), "token", "left")
    hot = known.where(F.col("n_records").isNotNull()).select(*columns)
    shuffles = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if totals.count() <= shuffles * HASHED_ROWS:  # a partition's totals fit in memory; beyond, the join sorts and may spill
        light = light.hint("shuffle_hash")
    cold = known.where(F.col("n_records").isNull()).drop("n_occurrences", "n_records").join(light, "token").select(*columns)
    return hot.unionByName(cold), n, mean


def scored_terms(tokenized: DataFrame) -> DataFrame:
    """(doc_idx, token, tf, df, cf, doc_len, n, score) of every term of every record."""
    return _scored(*_with_totals(tokenized)).drop("squares")


def _scored(joined: DataFrame, n: int, mean: float) -> DataFrame:
    rate = F.col("n_occurrences") / F.lit(float(max(n, 1)))
    tfn = F.col("tf") * F.log2(1 + F.lit(float(mean)) / F.col("doc_len"))
    return joined.select(
        "doc_idx", "token", "tf", F.col("n_records").alias("df"), F.col("n_occurrences").alias("cf"), "doc_len",
        F.lit(n).cast("bigint").alias("n"), _information(rate, tfn).alias("score"), "squares",
    )


def candidate_score(mean: float, minimum: float) -> Column:
    """The least score of a case among terms with the row's totals, less what rounding may take."""
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    least = minimum * F.sqrt(F.col("squares")) / idf
    return _information(F.col("cf") / F.col("n"), least * F.log2(1 + F.lit(float(mean)) / F.col("doc_len"))) * (1 - 1e-9) - 1e-12


def weighty_terms(tokenized: DataFrame, minimum: float = MIN_WEIGHT, part: int = HEAVY_PART) -> DataFrame:
    """(doc_idx, token): terms of at most n / part records whose share of their record's tf-idf norm is at least ``minimum``.

    Candidates by their score, then the exact check: w = tf * (ln((1 + n) / (1 + df)) + 1)
    over the root of the record's sum of w * w.
    """
    joined, n, mean = _with_totals(tokenized)
    rows = _scored(joined, n, mean)
    w = F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    few = F.col("df") * part <= F.col("n")
    candidate = few & ((F.col("cf") > F.col("n")) | (F.col("score") >= candidate_score(mean, minimum)))
    rows = rows.select("doc_idx", w.alias("w"), F.when(candidate, F.struct("token", w.alias("w"))).alias("c"))
    per_record = rows.groupBy("doc_idx").agg(F.sum(F.col("w") * F.col("w")).alias("s"), F.collect_list("c").alias("c"))
    kept = F.filter("c", lambda x: x["w"] / F.sqrt("s") >= minimum)
    return per_record.select("doc_idx", F.explode(kept).alias("x")).select("doc_idx", F.col("x.token").alias("token"))
