"""Orthographic normalisation with rules partly learned from the corpus."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charterloom.config import Config, parse_bigram_rules, parse_phonetic_rules
from charterloom.functions.text import SINGLE_LETTERS, apply_alphabet, char_class, fold_ligatures, reduce_phonetics, replace_in_order


def folded(text: Column, config: Config) -> Column:
    """Lower case, ligatures and, if enabled, bigram rules."""
    out = fold_ligatures(text)
    return replace_in_order(out, parse_bigram_rules(config.bigram_normalization_rules)) if config.bigram_normalization_enabled else out


def lost_characters(docs: DataFrame, config: Config = Config(), text: str = "text") -> DataFrame:
    """(ch, freq) of the characters of the basic plane that the alphabet would lose.

    Letters of the alphabet are removed before the characters are exploded,
    and counts combine before the shuffle; the result is at most 65,536 rows.
    """
    known = char_class(config.char_norm_alphabet + "".join(SINGLE_LETTERS) + " ")
    rest = F.regexp_replace(folded(F.col(text), config), rf"[{known}\x{{10000}}-\x{{10FFFF}}]", "")
    chars = docs.select(F.explode(F.split(rest, "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("ch").agg(F.count("*").alias("freq"))


def target_letter(ch: str, alphabet: str) -> str | None:
    """First character of the compatibility decomposition, if it is another letter of the alphabet."""
    first = unicodedata.normalize("NFKD", ch)[:1]
    return first if first in alphabet and first != ch and first.strip() else None


def learn_characters(docs: DataFrame, config: Config = Config(), text: str = "text") -> dict[str, str]:
    """Learned and fixed single-letter rules; one action, at most 65,536 rows come to the driver."""
    alphabet = config.char_norm_alphabet.replace(" ", "")
    rows = lost_characters(docs, config, text).where(F.col("freq") >= config.char_norm_min_freq).collect()
    learned = {r["ch"]: t for r in sorted(rows) if (t := target_letter(r["ch"], alphabet))}
    return learned | SINGLE_LETTERS


def learned_rules(docs: DataFrame, config: Config = Config(), text: str = "text") -> DataFrame:
    """(src, dst, freq) of the learned rules as a table."""
    alphabet = config.char_norm_alphabet.replace(" ", "")
    rows = lost_characters(docs, config, text).where(F.col("freq") >= config.char_norm_min_freq).collect()
    found = [(r["ch"], t, r["freq"]) for r in sorted(rows) if (t := target_letter(r["ch"], alphabet))]
    return docs.sparkSession.createDataFrame(found, "src string, dst string, freq bigint")


def normalized(text: Column, config: Config, mapping: dict[str, str]) -> Column:
    """The full normalisation of a text, phonetic reduction included where enabled."""
    out = apply_alphabet(folded(text, config), config.char_norm_alphabet, mapping)
    if config.phonetic_reduction_enabled:
        out = reduce_phonetics(out, config.phonetic_reduction_alphabet, parse_phonetic_rules(config.phonetic_reduction_rules))
    return out


def normalize_texts(docs: DataFrame, config: Config = Config(), text: str = "text") -> DataFrame:
    """``docs`` with ``norm_text``."""
    return docs.withColumn("norm_text", normalized(F.col(text), config, learn_characters(docs, config, text)))
