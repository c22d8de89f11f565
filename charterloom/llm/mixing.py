"""Mixing sources to target weights (problem 7).

Sizes are tokens of a public tokenizer.  The mixture has the greatest total at
which every source with documents can still give its target share at the
allowed repeats, so the shares are kept and the size gives way; another total
can be asked for, and then sources that cannot give their share give all they
may.  The share of a source without documents stays unfilled and is reported.

A source is used in whole passes as long as its budget allows; what remains is
fitted as a subset sum: documents are counted by exact token length, the
remaining budget is spread over the lengths in proportion (with the rounding
carried on), documents of any length are given back until the open budget
holds a window, and a bounded knapsack by dynamic programming, in units of the
lengths' greatest common divisor, fills it.  If it leaves a gap, the window
grows fourfold, in the end to the whole budget, so the sum is the largest
reachable one.  Only above ``MOST_CELLS`` units, where an exact fit was found
in no smaller window, the nearest sum found holds.  The documents of each length are drawn by
a seeded hash.

What one task sees is bounded by the number of distinct lengths, not by
documents: the knapsack works on (length, count) rows of one source.  The draw
ranks documents within (source, length, hash bucket), so a length that holds a
third of all rows is spread over ``BUCKETS`` groups, of which at most one is
cut by rank and the others are taken or left whole.

Defined results: documents with a null source or one without a target, and
documents of no tokens, are never used but count towards the tokens of all
documents.  A null ``max_repeats`` counts as 1, a null or negative one of the
numbers as 0, a null source in the targets is ignored.  A target without
documents has 0 tokens and cannot be reached unless its share is 0.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from charterloom.llm.tokenizer import DEFAULT_VOCABULARY, count_tokens
from charterloom.plans.materialize import materialize

BUCKETS = 256
WINDOW_TOKENS = 65_536
MOST_CELLS = 1 << 26

_PLAN = "source string, n_tokens bigint, n_docs bigint, base_repeats bigint, n_extra bigint"


def fit_budget(lengths: list[int], counts: list[int], budget: int, window: int = WINDOW_TOKENS, seed: int = 0) -> list[int]:
    """How many documents of each length to take once so that their sizes add up to at most ``budget``, as near as can be.

    Lengths are positive and distinct.
    """
    if budget >= sum(n * c for n, c in zip(lengths, counts, strict=True)):
        return list(counts)
    if budget <= 0 or budget < min(lengths):
        return [0] * len(lengths)
    unit = math.gcd(*lengths)
    lengths, budget = [n // unit for n in lengths], budget // unit
    part = budget / sum(n * c for n, c in zip(lengths, counts, strict=True))
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    take, carry = [0] * len(lengths), 0.0
    for k in order:  # proportional part; what rounding leaves is carried to the next length
        carry += lengths[k] * counts[k] * part
        take[k] = max(0, min(counts[k], int(carry // lengths[k])))
        carry -= take[k] * lengths[k]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    width = max(window // unit, 4 * max(lengths))
    best: tuple[int, list[int]] | None = None
    while True:
        while left < min(width, budget):  # give back documents of all lengths
            for k in order:
                if take[k] and left < width:
                    back = min(take[k], max(1, width // 16 // lengths[k]))
                    take[k] -= back
                    left += back * lengths[k]
        if best and left > MOST_CELLS:
            return best[1]
        more = _knapsack(lengths, [c - t for c, t in zip(counts, take, strict=True)], left)
        gap = left - sum(lengths[k] * n for k, n in more.items())
        if best is None or gap < best[0]:
            best = gap, [t + more.get(k, 0) for k, t in enumerate(take)]
        if not gap or not any(take):
            return best[1]
        width *= 4


def _knapsack(lengths: list[int], spare: list[int], target: int) -> dict[int, int]:
    """Bounded subset sum: how many of each length make the largest sum not above ``target``."""
    if target <= 0:
        return {}
    reached = np.zeros(target + 1, dtype=bool)
    reached[0] = True
    by = np.full(target + 1, -1, dtype=np.int32)
    parts: list[tuple[int, int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        most, chunk = min(spare[k], target // lengths[k]), 1
        while most > 0:  # binary splitting of the count
            chunk = min(chunk, most)
            size = chunk * lengths[k]
            new = reached[: target + 1 - size] & ~reached[size:]
            if new.any():
                by[size:][new] = len(parts)
                reached[size:] |= new
            parts.append((k, chunk))
            most -= chunk
            chunk *= 2
        if reached[target]:
            break
    at, out = int(np.flatnonzero(reached)[-1]), {}
    while at:
        k, chunk = parts[by[at]]
        out[k] = out.get(k, 0) + chunk
        at -= chunk * lengths[k]
    return out


def sized_documents(documents: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(source, doc_id, n_tokens), written once: the only pass over the texts."""
    return materialize(count_tokens(documents, ["source", "doc_id"], path=path), "sizes")


def plan_mixture(sized: DataFrame, targets: DataFrame, total: float | None = None, window: int = WINDOW_TOKENS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The plan per source and length, and the report per source.

    ``total`` is the size of the mixture in tokens; by default the greatest
    one at which every source with documents and a share gives its share.

    ``plan``: source, n_tokens, n_docs, base_repeats (of every document of the
    length) and n_extra (documents used once more).  ``report``: source,
    target_share, max_repeats, n_docs, source_tokens, budget_tokens (its share
    of the total), planned_tokens, shortfall_tokens (budget less plan),
    actual_share (of all planned tokens), reachable (whether it could give its
    share of a mixture as large as all documents).
    """
    histogram = materialize(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    every = histogram.agg(F.sum(F.col("n_tokens") * F.col("n_docs"))).first()[0] or 0
    share = F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))
    repeats = F.greatest(F.coalesce(F.col("max_repeats").cast("bigint"), F.lit(1)), F.lit(0))
    wanted = (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        .select("source", share.alias("target_share"), repeats.alias("max_repeats"))
    )
    held = histogram.where("n_tokens > 0").groupBy("source").agg(F.sum("n_docs").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("source_tokens"))
    wanted = wanted.join(held, "source", "left")
    if total is None:
        most = F.col("source_tokens") * F.col("max_repeats") / F.col("target_share")
        total = wanted.where("source_tokens is not null and target_share > 0").agg(F.min(most)).first()[0] or 0.0
    wanted = wanted.withColumn("budget", F.col("target_share") * F.lit(float(total)))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n_tokens")
        lengths, counts = rows.n_tokens.astype(int).tolist(), rows.n_docs.astype(int).tolist()
        size = sum(n * c for n, c in zip(lengths, counts, strict=True))
        budget, most = int(rows.budget.iloc[0] + 1e-6), int(rows.max_repeats.iloc[0])
        base = min(most, budget // size)
        extra = [0] * len(lengths) if base >= most else fit_budget(lengths, counts, budget - base * size, window, seed)
        return pd.DataFrame({"source": key[0], "n_tokens": lengths, "n_docs": counts, "base_repeats": base, "n_extra": extra})

    own = wanted.select("source", "max_repeats", "budget")
    plan = materialize(histogram.where("n_tokens > 0").join(own, "source").groupBy("source").applyInPandas(fit, _PLAN), "plan")
    used = F.sum(F.col("n_tokens") * (F.col("n_docs") * F.col("base_repeats") + F.col("n_extra")))
    planned = plan.agg(used).first()[0] or 0
    zero = F.lit(0).cast("bigint")
    report = wanted.join(plan.groupBy("source").agg(used.alias("planned_tokens")), "source", "left").select(
        "source", "target_share", "max_repeats",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("n_docs", "source_tokens")],
        F.col("budget").alias("budget_tokens"),
        F.coalesce(F.col("planned_tokens"), zero).alias("planned_tokens"),
        F.greatest(F.col("budget") - F.coalesce(F.col("planned_tokens"), zero), F.lit(0.0)).alias("shortfall_tokens"),
        (F.coalesce(F.col("planned_tokens"), zero) / F.lit(float(max(planned, 1)))).alias("actual_share"),
        (F.coalesce(F.col("source_tokens"), zero) * F.col("max_repeats") >= F.col("target_share") * F.lit(float(every))).alias("reachable"),
    )
    return plan, report


def draw(sized: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """(source, doc_id, n_tokens, repeats) of the documents in the mixture.

    Among the documents of one source and length the ones with the smallest
    seeded hash are used once more than the others; equal hashes go by doc_id.
    """
    keyed = sized.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id"))
    keyed = keyed.withColumn("_bucket", F.pmod(F.shiftright("_hash", 7), F.lit(BUCKETS)).cast("int"))
    group = ["source", "n_tokens"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        keyed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(plan.select(*group, "base_repeats", "n_extra"), group)
        .select(*group, "_bucket", "base_repeats", F.greatest(F.col("n_extra") - F.col("_before"), F.lit(0)).alias("_quota"), "_n")
        .where((F.col("base_repeats") > 0) | (F.col("_quota") > 0))
    )
    rows = keyed.join(quota, [*group, "_bucket"])
    rank = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_hash", "doc_id"))
    repeats = (F.col("base_repeats") + F.when(F.col("_rank") <= F.col("_quota"), 1).otherwise(0)).alias("repeats")
    return rows.withColumn("_rank", rank).select("source", "doc_id", "n_tokens", repeats).where("repeats > 0")


def unreachable(documents: DataFrame, targets: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Sources of the targets that cannot reach their share even at the allowed repeats."""
    _, report = plan_mixture(sized_documents(documents, path), targets)
    return report.where(~F.col("reachable")).select("source")
