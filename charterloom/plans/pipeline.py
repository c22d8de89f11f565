"""The whole run: documents to similarity, threshold and reports."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charterloom.config import Config
from charterloom.operators import autotune, bpe, encode, features, normalize, reports, similarity, threshold, vocab
from charterloom.plans.materialize import materialize
from charterloom.sources.files import load_corpora


@dataclass
class Result:
    """Tables and choices of a run."""

    docs: DataFrame
    tokens: DataFrame
    weights: DataFrame
    pairs: DataFrame
    threshold: float
    config: Config
    inter: bool
    files: list[str]


def tokenize(docs: DataFrame, config: Config) -> tuple[DataFrame, bpe.Merges]:
    """(doc_idx, corpus, tokens): normalised texts in subwords learned from them, and the learned merges."""
    norm = materialize(normalize.normalize_texts(docs, config).select("doc_idx", "corpus", "norm_text"), "norm")
    counts = materialize(vocab.word_counts(norm), "words")
    size = vocab.suggest_size(counts, config.vocab_min_word_freq, config.vocab_coverage) if str(config.vocab_size) == "auto" else int(config.vocab_size)
    merges = bpe.learn(counts, vocab.capped_size(counts, size))
    return materialize(bpe.tokenize(norm, merges, ["doc_idx", "corpus"]), "tokens"), merges


def compare(docs: DataFrame, tokens: DataFrame, config: Config, inter: bool) -> tuple[DataFrame, DataFrame, Config, DataFrame]:
    """(weights, pairs, config, featureful) of tokenised documents; the config may have tuned window settings.

    ``featureful`` (doc_idx) are the documents with features, shared or not:
    the diagonal of a corpus against itself.  It is taken before weights drop
    documents that share nothing.
    """
    dictionary = materialize(encode.token_dictionary(tokens), "ids")
    size = dictionary.count()
    encoded = materialize(encode.encode(tokens, dictionary, ["doc_idx", "corpus"]), "encoded")
    if config.auto_tune:
        grid = autotune.tune(autotune.sample_documents(encoded.where("corpus = 1"), config.auto_tune_sample_size))
        ngram, n_out = autotune.best_setting(grid, (config.ngram, config.n_out))
        config = replace(config, ngram=ngram, n_out=n_out)
    postings = materialize(features.feature_counts(encoded, size, ["doc_idx", "corpus"], config.ngram, config.n_out), "postings")
    weights = materialize(similarity.shared_weights(postings, docs.count()), "weights")
    pairs = similarity.cosine_inter(weights) if inter else similarity.cosine_intra(weights)
    return weights, materialize(pairs, "pairs"), config, materialize(postings.select("doc_idx").distinct(), "featureful")


def cutoff(pairs: DataFrame, featureful: DataFrame, config: Config, inter: bool) -> float:
    """The similarity cutoff; within one corpus pairs count twice and the diagonal once, as a symmetric matrix stores them."""
    scores = pairs.select("score", F.lit(1).cast("bigint").alias("weight")) if inter else threshold.weighted_scores(pairs, featureful.count())
    return threshold.choose(scores, config.similarity_threshold, config.auto_threshold_method)


def run(docs: DataFrame, config: Config, inter: bool = False, folder: str | None = None, single: bool = True) -> Result:
    """All stages over loaded documents (doc_idx, corpus, name, path, text); reports go to ``folder``, tables without ``single`` as folders of parts."""
    docs = materialize(docs.select("doc_idx", "corpus", "name", "path", "text"), "docs")
    tokens, merges = tokenize(docs, config)
    weights, pairs, config, featureful = compare(docs, tokens, config, inter)
    least = cutoff(pairs, featureful, config, inter)
    files = []
    if folder:
        os.makedirs(folder, exist_ok=True)
        at = lambda name: os.path.join(folder, name)
        files.append(reports.write_pairs(pairs, at("dist_mat.parquet")))
        merges.save(at("subword_merges.json"))
        files.append(at("subword_merges.json"))
        if not config.no_reports:
            if config.gen_heatmap and (page := reports.write_heatmap(pairs, docs, at("similarity_heatmap.html"), None if inter else featureful)):
                files.append(page)
            if config.gen_comparison_html:
                files += reports.write_comparison_html(pairs, docs, least, folder, config.max_gap_words, config.fuzz_threshold)
            if config.gen_summary_tsv:
                files.append(reports.write_summary_tsv(pairs, docs, least, at("similarity_summary.tsv"), inter, single))
            if config.gen_linguistic_tsv:
                files.append(reports.write_variations_tsv(pairs, docs, least, at("linguistic_variations.tsv"), config.fuzz_threshold, config.max_gap_words, single))
    return Result(docs, tokens, weights, pairs, least, config, inter, files)


def run_folders(spark: SparkSession, config: Config, folder: str) -> Result:
    """A run over one or two folders of text files."""
    if not config.input_path:
        raise ValueError("input_path is required")
    docs, inter = load_corpora(spark, config.input_path, config.input_path2, config.file_suffix, config.min_text_length, config.keep_texts)
    return run(docs, config, inter, folder)
