"""Choosing (ngram, n_out) by injecting noise into a sample of documents."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charterloom.operators.features import keep_masks

#: The settings tried, in order.
GRID = ((4, 0), (4, 1), (5, 0), (5, 1), (5, 2), (6, 0), (6, 1), (6, 2), (7, 1), (7, 2))
DROP, SKIP_BACK, MIN_SIGNAL, SEED = 0.05, 0.5, 0.05, 42


def sample_documents(encoded: DataFrame, size: int = 30) -> list[list[int]]:
    """The first ``size`` token lists by document; the size bounds what comes to the driver."""
    rows = encoded.orderBy("doc_idx").limit(size).select(F.col("ids")).collect()
    return [list(r["ids"] or []) for r in rows]


def perturb(documents: list[list[int]], seed: int = SEED) -> list[list[int]]:
    """Drop one token in twenty and, for every second of these, the kept token before it."""
    random = np.random.RandomState(seed)
    noisy = []
    for ids in documents:
        out: list[int] = []
        for token in ids:
            if random.rand() < DROP:
                if random.rand() < SKIP_BACK and out:
                    out.pop()
            else:
                out.append(token)
        noisy.append(out)
    return noisy


def _unit(ids: list[int], ngram: int, n_out: int) -> dict[tuple, float]:
    masks = keep_masks(ngram, n_out)
    counts = Counter(tuple(ids[w + k] for k in m) for m in masks for w in range(len(ids) - ngram + 1))
    norm = math.sqrt(sum(c * c for c in counts.values())) or 1.0
    return {f: c / norm for f, c in counts.items()}


def _cosine(a: dict, b: dict) -> float:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return sum(x * large.get(f, 0.0) for f, x in small.items())


def tune(documents: list[list[int]]) -> list[tuple[int, int, int, float, float, float]]:
    """(grid_pos, ngram, n_out, signal, noise, score) of each setting; nothing for fewer than two documents."""
    if len(documents) < 2:
        return []
    noisy, out, k = perturb(documents), [], len(documents)
    for place, (ngram, n_out) in enumerate(GRID):
        first = [_unit(d, ngram, n_out) for d in documents]
        second = [_unit(d, ngram, n_out) for d in noisy]
        signal = sum(_cosine(a, b) for a, b in zip(first, second, strict=True)) / k
        noise = sum(_cosine(first[i], second[j]) for i in range(k) for j in range(k) if i != j) / (k * (k - 1))
        out.append((place, ngram, n_out, signal, noise, signal - noise))
    return out


def best_setting(results: list[tuple], current: tuple[int, int]) -> tuple[int, int]:
    """First setting with the greatest difference among those with enough signal, else the current one."""
    good = [r for r in results if r[3] > MIN_SIGNAL]
    best = max(good, key=lambda r: (r[5], -r[0]), default=None)
    return (best[1], best[2]) if best and best[5] > -1 else current


def autotune_grid(encoded: DataFrame, size: int = 30) -> DataFrame:
    """The grid with its scores as a table."""
    schema = "grid_pos int, ngram int, n_out int, signal double, noise double, snr double"
    return encoded.sparkSession.createDataFrame(tune(sample_documents(encoded, size)), schema)
