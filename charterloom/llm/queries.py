"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charterloom.llm import distinctive, frequency, groups, mixing, sentences, spans, tokenizer, visible
from charterloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return visible.look_same_pairs(table(spark, d, "corpus"))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    return visible.normalize_visible(table(spark, d, "corpus"))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    return visible.look_same_members(table(spark, d, "corpus"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    runs = spans.shared_spans(table(spark, d, "tokenized_corpus"), table(spark, d, "formulary"))
    return runs.select("doc_idx", "start_pos", "n_tokens")


def p2_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "tokenized_corpus"), table(spark, d, "formulary"))


def p2_share(spark: SparkSession, d: str) -> DataFrame:
    tokenized = table(spark, d, "tokenized_corpus")
    return spans.shared_share(tokenized, spans.shared_spans(tokenized, table(spark, d, "formulary")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.weighty_terms(table(spark, d, "tokenized_corpus"))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.scored_terms(table(spark, d, "tokenized_corpus")).withColumn("score", F.round("score", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, d, "tokenized_corpus")).where("mark is not null")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, d, "tokenized_corpus"))


def p4_names(spark: SparkSession, d: str) -> DataFrame:
    return frequency.value_frequencies(table(spark, d, "corpus"), "doc_idx", "name", "loaded_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.match_groups(table(spark, d, "dist_mat"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_texts(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.unreachable(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan_mixture(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))[1]


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, d, "documents"))
    return mixing.draw(sized, mixing.plan_mixture(sized, table(spark, d, "mix_targets"))[0])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_forms, p1_members, p2_found, p2_spans, p2_share, p3_found, p3_scores, p4_found, p4_terms, p4_names, p5_found, p6_ids, p7_found, p7_shares, p7_mixture, p8_found)
    return {f.__name__: f for f in own}
