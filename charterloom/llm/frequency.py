"""Frequency of every distinct term (problem 4).

Every record emits its terms with their counts; the counts are combined by
hash, first within an Arrow batch and then within each task, before the
shuffle, so a term that stands in every record crosses the network once per
task, and are then summed to occurrences and records.  Frequency bounds mark
the terms that are too rare or too common.

Null and empty elements are no terms.  Repeated rows of a record are the same
record and count once (the latest row holds).  Records with null or empty
token lists count among the records.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charterloom.functions.batches import by_elements
from charterloom.sources.tables import latest_rows

RARE_OCCURRENCES = 2
COMMON_SHARE = 0.25


def records(tokenized: DataFrame) -> DataFrame:
    """One row (doc_idx, tokens) for each record."""
    return latest_rows(tokenized, "doc_idx", "tokenized_at", ["tokens"])


def _batch_counts(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a batch, and for each (row, term) the row, the term's number and its count; null and empty elements are left out."""
    offsets = lists.offsets.to_numpy()
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    terms = flat.dictionary
    blank = np.array([not t for t in terms.to_pylist()] + [True])
    code = flat.indices.fill_null(len(terms)).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = ~blank[code]
    key, count = np.unique(row[keep] * (len(terms) + 1) + code[keep], return_counts=True)
    return terms, key // (len(terms) + 1), key % (len(terms) + 1), count


def record_terms(rows: DataFrame) -> DataFrame:
    """(doc_idx, token, tf, doc_len, squares): the term counts of each record, their sum and the sum of their squares, taken where the record is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_elements(whole, 1)):
            terms, row, code, count = _batch_counts(batch.column(1))
            length, squares = (np.bincount(row, weights=w, minlength=1).astype(np.int64)[row] for w in (count, count * count))
            columns = [batch.column(0).take(pa.array(row)), terms.take(pa.array(code)), pa.array(count), pa.array(length), pa.array(squares)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_idx", "token", "tf", "doc_len", "squares"])

    return rows.where("tokens is not null").select(F.col("doc_idx").cast("bigint"), "tokens").mapInArrow(run, "doc_idx bigint, token string, tf bigint, doc_len bigint, squares bigint")


def collection_counts(rows: DataFrame) -> DataFrame:
    """(token, n_occurrences, n_records) of each batch: the records' counts combined before they leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_elements(whole, 0)):
            terms, _, code, count = _batch_counts(batch.column(0))
            held = np.bincount(code, minlength=len(terms))[: len(terms)]
            total = np.bincount(code, weights=count, minlength=len(terms))[: len(terms)].astype(np.int64)
            there = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(there)), pa.array(total[there]), pa.array(held[there])], names=["token", "n_occurrences", "n_records"])

    partial = rows.where("tokens is not null").select("tokens").mapInArrow(run, "token string, n_occurrences bigint, n_records bigint")
    return partial.groupBy("token").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def term_totals(terms: DataFrame) -> DataFrame:
    """(token, n_occurrences, n_records) of the records' term counts."""
    return terms.groupBy("token").agg(F.sum("tf").alias("n_occurrences"), F.count("*").alias("n_records"))


def n_records(tokenized: DataFrame) -> int:
    """Records of the collection, those without tokens included."""
    return tokenized.where(F.col("doc_idx").isNotNull()).agg(F.count_distinct("doc_idx")).first()[0]


def mark(n: int, rare: int = RARE_OCCURRENCES, share: float = COMMON_SHARE) -> Column:
    """'rare', 'common' or null; a term that is both (tiny collections) is rare."""
    return F.when(F.col("n_occurrences") <= rare, F.lit("rare")).when(F.col("n_records") > F.lit(share * n), F.lit("common"))


def term_frequencies(tokenized: DataFrame, rare: int = RARE_OCCURRENCES, share: float = COMMON_SHARE) -> DataFrame:
    """(token, n_occurrences, n_records, mark) of every distinct term; mark is null for useful ones."""
    totals = collection_counts(records(tokenized))
    return totals.withColumn("mark", mark(n_records(tokenized), rare, share))


def value_frequencies(df: DataFrame, key: str, value: str, at: str, rare: int = RARE_OCCURRENCES, share: float = COMMON_SHARE) -> DataFrame:
    """As :func:`term_frequencies`, of the whole values of a column; null and empty values are none."""
    rows = latest_rows(df, key, at, [value]).select(F.array(F.col(value).cast("string")).alias("tokens"))
    n = df.where(F.col(key).isNotNull()).agg(F.count_distinct(key)).first()[0]
    return collection_counts(rows).withColumn("mark", mark(n, rare, share))
