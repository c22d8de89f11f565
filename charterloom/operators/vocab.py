"""Word statistics and the size of the subword vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from charterloom.functions.text import common_prefix_length, words
from charterloom.plans.materialize import materialize

MAX_AFFIX = 6
DEFAULT_SIZE = 2000


def word_counts(norm: DataFrame, text: str = "norm_text") -> DataFrame:
    """(word, freq) of normalised texts."""
    return norm.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def longest_word(counts: DataFrame) -> DataFrame:
    """(n_letters): length of the longest word, 0 without words."""
    return counts.agg(F.coalesce(F.max(F.length("word")), F.lit(0)).alias("n_letters"))


def preview(docs: DataFrame, tokens: DataFrame, most: int = 25, text: str = "norm_text") -> DataFrame:
    """(doc_idx, words, tokens): the first ``most`` words and subwords of the first document, to look at."""
    first = docs.where(F.col("doc_idx") == docs.select(F.min("doc_idx")).scalar())
    return first.join(tokens.select("doc_idx", "tokens"), "doc_idx").select("doc_idx", F.slice(words(F.col(text)), 1, most).alias("words"), F.slice("tokens", 1, most).alias("tokens"))


def frequent_words(counts: DataFrame, min_freq: int = 5) -> DataFrame:
    """Words of more than one letter with at least ``min_freq`` occurrences."""
    return counts.where((F.col("freq") >= min_freq) & (F.length("word") > 1))


def neighbour_affixes(counts: DataFrame, suffix: bool = False, longest: int = MAX_AFFIX) -> DataFrame:
    """(affix, freq) for each two neighbouring words in sorted order with 2 to ``longest`` letters in common.

    Words with two letters in common start with the same two letters, so the
    sort runs within these groups instead of in one task.
    """
    key = F.reverse("word") if suffix else F.col("word")
    rows = counts.select(key.alias("w"), "freq").withColumn("head", F.substring("w", 1, 2))
    order = Window.partitionBy("head").orderBy("w")
    pairs = rows.select("w", F.lead("w").over(order).alias("next"), (F.col("freq") + F.lead("freq").over(order)).alias("freq")).where("next is not null")
    size = common_prefix_length(F.col("w"), F.col("next"), longest + 1)
    found = pairs.withColumn("n", size).where(F.col("n").between(2, longest))
    affix = F.expr("substring(w, 1, n)")
    return found.select((F.reverse(affix) if suffix else affix).alias("affix"), "freq")


def affix_counts(counts: DataFrame, longest: int = MAX_AFFIX) -> DataFrame:
    """(affix, c): prefixes and suffixes in one counter."""
    both = neighbour_affixes(counts, False, longest).unionByName(neighbour_affixes(counts, True, longest))
    return both.groupBy("affix").agg(F.sum("freq").alias("c"))


def coverage_rank(counts: DataFrame, column: str, share: float) -> int | None:
    """How many of the largest counts cover ``share`` of their sum; None without rows.

    Equal counts are combined first, so the running sum goes over the distinct
    counts, whose number grows with the root of the total at most.
    """
    levels = counts.groupBy(F.col(column).alias("c")).agg(F.count("*").alias("n"))
    total = levels.agg(F.sum(F.col("c") * F.col("n"))).first()[0]
    if not total:
        return None
    target = share * total
    before = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    running = levels.withColumn("before", F.coalesce(F.sum(F.col("c") * F.col("n")).over(before), F.lit(0)))
    used = F.least(F.col("n"), F.ceil((F.lit(target) - F.col("before")) / F.col("c")))
    return running.where(F.col("before") < target).agg(F.sum(used)).first()[0]


def suggest_size(counts: DataFrame, min_freq: int = 5, coverage: float = 0.85) -> int:
    """Affixes that cover the share, plus 256; 2000 where there are no frequent words or affixes."""
    affixes = materialize(affix_counts(frequent_words(counts, min_freq)), "affixes")
    k = coverage_rank(affixes, "c", coverage)
    return DEFAULT_SIZE if k is None else int(k) + 256


def capped_size(counts: DataFrame, requested: int) -> int:
    """At most the number of distinct words plus 256."""
    return min(requested, counts.count() + 256)
