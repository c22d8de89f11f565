"""Subword segmentation learned from the corpus' own words, as the reference pipeline does.

This belongs to the reference's similarity pipeline (subwords bring spelling
variants together).  The training-data operators use public vocabularies only.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charterloom.functions.batches import by_bytes
from charterloom.plans.materialize import discard, materialize

SPECIAL = 5
#: Up to so many distinct words are merged on the driver, more in rounds where they lie.
MAX_DRIVER_WORDS = 1_000_000
#: Most frequent pairs that a round looks at, and merges after which the words are written anew.
ROUND_PAIRS, ROUND_MERGES = 4096, 64


class Merges:
    """Learned merges; segments words by them in order."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.pairs = pairs
        self.rank = {p: k for k, p in enumerate(pairs)}

    def segment(self, word: str) -> list[str]:
        parts = list(word)
        while len(parts) > 1:
            rank, at = min((self.rank.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            a, b = self.pairs[rank]
            merged, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b:
                    merged.append(a + b)
                    k += 2
                else:
                    merged.append(parts[k])
                    k += 1
            parts = merged
        return parts

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.pairs, f, ensure_ascii=False)

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            return cls([tuple(p) for p in json.load(f)])


def learn_merges(counts: dict[str, int], size: int) -> Merges:
    """Merge the most frequent neighbouring pair until the vocabulary has ``size`` entries.

    Special tokens and distinct characters come first; ties go to the smaller
    ids.  Pair counts are kept up to date by the words that hold the pair.
    """
    words = [(list(w), c) for w, c in sorted(counts.items())]
    alphabet = sorted({ch for w, _ in words for ch in w})
    ids = {ch: SPECIAL + k for k, ch in enumerate(alphabet)}
    total: dict[tuple[str, str], int] = defaultdict(int)
    holders: dict[tuple[str, str], set[int]] = defaultdict(set)
    for k, (parts, c) in enumerate(words):
        for pair in zip(parts, parts[1:], strict=False):
            total[pair] += c
            holders[pair].add(k)
    heap = [(-c, ids[a], ids[b], a, b) for (a, b), c in total.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    while SPECIAL + len(alphabet) + len(merges) < size and heap:
        count, _, _, a, b = heapq.heappop(heap)
        now = total.get((a, b), 0)
        if now <= 0:
            continue
        if now != -count:
            heapq.heappush(heap, (-now, ids[a], ids[b], a, b))
            continue
        new = a + b
        ids.setdefault(new, SPECIAL + len(alphabet) + len(merges))
        merges.append((a, b))
        changed: set[tuple[str, str]] = set()
        for k in list(holders.pop((a, b), ())):
            parts, c = words[k]
            merged, at = [], 0
            while at < len(parts):
                if at + 1 < len(parts) and parts[at] == a and parts[at + 1] == b:
                    merged.append(new)
                    at += 2
                else:
                    merged.append(parts[at])
                    at += 1
            if len(merged) == len(parts):
                continue
            for pair in zip(parts, parts[1:], strict=False):
                total[pair] -= c
            for pair in zip(merged, merged[1:], strict=False):
                total[pair] += c
                holders[pair].add(k)
                changed.add(pair)
            words[k] = (merged, c)
        total.pop((a, b), None)
        for x, y in changed:
            if total.get((x, y), 0) > 0:
                heapq.heappush(heap, (-total[x, y], ids[x], ids[y], x, y))
    return Merges(merges)


def certain_merges(rows: list[tuple[int, int, int]], whole: bool, ids: dict[str, int], merges: list[tuple[str, str]], first: int, room: int) -> list[tuple[int, int, int]]:
    """The next merges (a, b, new) that the most frequent pairs (a, b, count) settle without counting again; ``ids`` and ``merges`` grow.

    ``rows`` go by falling count, then ids; ``whole`` tells that no pair is
    missing.  A merge changes only counts of pairs that end in its first or
    start in its second symbol, and the pairs it makes are at most as frequent
    as those.  So the next row is the next merge as long as every such pair is
    rarer than it.
    """
    names = {k: w for w, k in ids.items()}
    groups: dict[int, tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))
    for a, b, n in rows:
        groups[n][0].add(a)
        groups[n][1].add(b)
    firsts: set[int] = set()
    seconds: set[int] = set()
    found: list[tuple[int, int, int]] = []
    for a, b, n in rows[:room]:
        if found and (not whole and n == rows[-1][2] or not firsts.isdisjoint(groups[n][1]) or not seconds.isdisjoint(groups[n][0])):
            break
        new = names[a] + names[b]
        again = new in ids
        names[ids.setdefault(new, first + len(merges))] = new
        merges.append((names[a], names[b]))
        found.append((a, b, ids[new]))
        firsts.add(a)
        seconds.add(b)
        if a == b or again:  # the pairs it makes may be more frequent than the bound above
            break
    return found


def _merged(parts: list[int], steps: list[tuple[int, int, int]], pairs: set[tuple[int, int]]) -> list[int]:
    """``parts`` after the merges ``steps`` in order; ``pairs`` are those of the steps."""
    if pairs.isdisjoint(zip(parts, parts[1:], strict=False)):
        return parts
    for a, b, new in steps:
        if a in parts and b in parts:
            out, at = [], 0
            while at < len(parts):
                if at + 1 < len(parts) and parts[at] == a and parts[at + 1] == b:
                    out.append(new)
                    at += 2
                else:
                    out.append(parts[at])
                    at += 1
            parts = out
    return parts


def learn_in_rounds(word_counts: DataFrame, size: int, most_pairs: int = ROUND_PAIRS) -> Merges:
    """The merges of ``learn_merges`` without holding the words in one place.

    A round counts the pairs of all words and brings the most frequent ones to
    the driver, which settles as many merges as these allow.
    """

    def characters(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set().union(*batch.column(0).to_pylist())), pa.string())], names=["ch"])

    alphabet = sorted(r["ch"] for r in word_counts.select("word").mapInArrow(characters, "ch string").distinct().collect())
    ids = {ch: SPECIAL + k for k, ch in enumerate(alphabet)}
    letters = dict(ids)

    def spelled(batches):
        for batch in batches:
            parts = [[letters[ch] for ch in w] for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.list_(pa.int32())), batch.column(1)], names=["parts", "freq"])

    kind = "parts array<int>, freq bigint"
    words = materialize(word_counts.select("word", F.col("freq").cast("bigint").alias("freq")).mapInArrow(spelled, kind), "spelled")
    merges: list[tuple[str, str]] = []
    steps: list[tuple[int, int, int]] = []
    first = SPECIAL + len(alphabet)
    while first + len(merges) < size:
        now, pairs = list(steps), {(a, b) for a, b, _ in steps}

        def count(batches, now=now, pairs=pairs):
            for batch in batches:
                total: dict[tuple[int, int], int] = defaultdict(int)
                for parts, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    parts = _merged(parts, now, pairs)
                    for pair in zip(parts, parts[1:], strict=False):
                        total[pair] += c
                columns = [pa.array([p[0] for p in total], pa.int32()), pa.array([p[1] for p in total], pa.int32()), pa.array(total.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

        def rewrite(batches, now=now, pairs=pairs):
            for batch in batches:
                parts = [_merged(p, now, pairs) for p in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.list_(pa.int32())), batch.column(1)], names=["parts", "freq"])

        if len(steps) >= ROUND_MERGES:
            old, steps = words, []
            words = materialize(old.mapInArrow(rewrite, kind).where("size(parts) > 1"), "spelled")
            discard(old)
            continue
        counted = words.mapInArrow(count, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")
        rows = [tuple(r) for r in counted.orderBy(F.desc("n"), "a", "b").limit(most_pairs).collect()]
        if not rows:
            break
        steps += certain_merges(rows, len(rows) < most_pairs, ids, merges, first, size - first - len(merges))
    discard(words)
    return Merges(merges)


def learn(word_counts: DataFrame, size: int, most: int = MAX_DRIVER_WORDS) -> Merges:
    """Merges from all distinct words; up to ``most`` come to the driver, more are counted in rounds with the same result."""
    if word_counts.count() > most:
        return learn_in_rounds(word_counts, size)
    return learn_merges({r["word"]: r["freq"] for r in word_counts.select("word", "freq").collect()}, size)


def tokenize(norm: DataFrame, merges: Merges, keys: list[str], text: str = "norm_text") -> DataFrame:
    """(keys, tokens): subwords of the white-space separated words; each worker segments a word once."""
    shared = norm.sparkSession.sparkContext.broadcast(merges)

    def run(batches):
        memo: dict[str, list[str]] = {}
        segmenter = shared.value
        for batch in by_bytes(batches):
            out = []
            for body in batch.column(len(keys)).to_pylist():
                tokens: list[str] = []
                for word in (body or "").split():
                    if word not in memo:
                        if len(memo) > 500_000:
                            memo.clear()
                        memo[word] = segmenter.segment(word)
                    tokens += memo[word]
                out.append(tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.list_(pa.string()))], names=[*keys, "tokens"])

    source = norm.select(*keys, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keys)
    return source.mapInArrow(run, f"{kinds}, tokens array<string>")
