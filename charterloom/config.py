"""Run configuration and rule strings."""

from __future__ import annotations

import string
import warnings
from dataclasses import dataclass, fields

#: The default rule strings.
PHONETIC_RULES = "b>p,c>k,d>t,g>k,j>i,q>k,v>f,y>i,z>s"
PHONETIC_ALPHABET = "aefiklmnopqrstuwxz"
BIGRAM_RULES = "ss>s,ff>f,tt>t,ll>l,ie>i,au>u,ei>i,eu>u,oh>o,ah>a,eh>e,uh>u"


def parse_rules(rules: str, source: range, target: range) -> dict[str, str]:
    """``"a>b,c>d"`` to an ordered dict; rules of another shape are skipped with a warning.

    ``source`` and ``target`` are the allowed lengths.  A repeated source
    keeps its first place and takes its last value.
    """
    out: dict[str, str] = {}
    for rule in (rules or "").split(","):
        parts = [p.strip() for p in rule.split(">")]
        if len(parts) == 2 and len(parts[0]) in source and len(parts[1]) in target:
            out[parts[0]] = parts[1]
        elif any(parts):
            warnings.warn(f"rule {rule.strip()!r} is skipped", stacklevel=3)
    return out


def parse_phonetic_rules(rules: str) -> dict[str, str]:
    """Simultaneous replacements of one character by one."""
    return parse_rules(rules, range(1, 2), range(1, 2))


def parse_bigram_rules(rules: str) -> dict[str, str]:
    """Sequential replacements of two or more characters by one."""
    return parse_rules(rules, range(2, 1 << 30), range(1, 2))


@dataclass(frozen=True)
class Config:
    """All settings of a run, with the reference's defaults."""

    input_path: str = ""
    input_path2: str = ""
    file_suffix: str = ".txt"
    keep_texts: int = 10_000
    ngram: int = 6
    n_out: int = 1
    min_text_length: int = 150
    similarity_threshold: str = "auto"
    auto_threshold_method: str = "otsu"
    char_norm_alphabet: str = string.ascii_lowercase
    char_norm_strategy: str = "normalize"
    char_norm_min_freq: int = 1
    phonetic_reduction_enabled: bool = False
    phonetic_reduction_alphabet: str = PHONETIC_ALPHABET
    phonetic_reduction_rules: str = PHONETIC_RULES
    bigram_normalization_enabled: bool = False
    bigram_normalization_rules: str = BIGRAM_RULES
    vocab_size: str = "auto"
    vocab_min_word_freq: int = 5
    vocab_coverage: float = 0.85
    fuzz_threshold: float = 0.75
    max_gap_words: int = 5
    auto_tune: bool = False
    auto_tune_sample_size: int = 30
    no_reports: bool = False
    gen_comparison_html: bool = True
    gen_summary_tsv: bool = True
    gen_linguistic_tsv: bool = True
    gen_heatmap: bool = True

    def __post_init__(self) -> None:
        if self.ngram - self.n_out < 1:
            raise ValueError("ngram - n_out must be at least 1")
        if self.char_norm_strategy != "normalize":
            raise ValueError(f"unknown char_norm_strategy {self.char_norm_strategy!r}")
        if self.auto_threshold_method not in ("otsu", "percentile"):
            raise ValueError(f"unknown auto_threshold_method {self.auto_threshold_method!r}")
        if str(self.vocab_size) != "auto" and not str(self.vocab_size).isdigit():
            raise ValueError("vocab_size is 'auto' or a whole number")
        if str(self.similarity_threshold) != "auto":
            float(self.similarity_threshold)
        for name in ("char_norm_alphabet", "phonetic_reduction_alphabet"):
            letters = getattr(self, name).replace(" ", "")
            if len(set(letters)) < len(letters):
                raise ValueError(f"{name} repeats a letter")

    @classmethod
    def keys(cls) -> list[str]:
        return [f.name for f in fields(cls)]
