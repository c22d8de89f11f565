"""Long exact spans shared between records (problem 2).

Level-wise doubling.  Level m/2: every window of m tokens keeps its minimizer,
the window of m/2 tokens with the smallest hash in it, so a window of m tokens
can only be repeated if its minimizer is; only minimizers found in two records
go on.  Level m: the windows of m tokens around them are compared.  Level 2m,
4m ...: two neighbouring windows that are both repeated make a candidate of
twice the length, until no candidates survive.

Tokens become 64-bit codes in the first pass; from then on codes and hashes
are shipped, never tokens.  Equal sequences are one text: a group of copies,
whatever its size, takes part once, and what it shares is given to all its
members.  Records that are no copies stay where they are; the list of the
others is broadcast up to a checked size and joined by shuffle beyond it.
Windows are compared by hashes of 128 bits (64 in the level m/2, which only
filters) of their codes, not token by token: two different windows count as
equal if both hashes collide, or if two tokens share a 64-bit code.

A window that fills more than one of ``HEAVY_PART`` rows of its level is heavy.
There are at most ``HEAVY_PART`` of these, whatever the data, so they are
broadcast, and no key of the join that remains is hot.

Null and empty elements keep their positions but equal nothing, so no shared
position is one of them.  Repeated rows of a record count once (the latest
row holds).  Records shorter than the minimum share nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charterloom.functions.batches import binary_offsets, by_elements
from charterloom.plans.materialize import discard, materialize
from charterloom.sources.tables import bounded

MIN_TOKENS = 20
HEAVY_PART = 10_000

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(codes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of every ``width`` consecutive codes of a flat array, modulo 2^64."""
    n = len(codes) - width + 1
    acc = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        acc = acc * base + codes[k : n + k]
    return _mixed(acc)


def _encoded(rows: DataFrame, minimum: int) -> DataFrame:
    """(row, rec, at, n, d1, d2, codes) of every row of a record: 64-bit codes of its tokens, 0 for null and empty ones, and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_elements(whole, 3)):
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            table = np.array([(xxhash.xxh3_64_intdigest(w) or 1) if w else 0 for w in flat.dictionary.to_pylist()] + [0], dtype=np.uint64)
            codes = table[flat.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]
            ends = offsets - offsets[0]
            long = np.diff(offsets) >= minimum
            parts = [codes[a:b].tobytes() if keep else b"" for a, b, keep in zip(ends[:-1].tolist(), ends[1:].tolist(), long.tolist(), strict=True)]
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), dtype=np.int64).reshape(-1, 2)
            columns = [*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int32)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "rec", "at", "n", "d1", "d2", "codes"])

    known = rows.where(F.col("rec").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    source = known.select("row", "rec", "at", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    return source.mapInArrow(run, "row bigint, rec bigint, at timestamp_ntz, n int, d1 bigint, d2 bigint, codes binary")


class _Flat:
    """Codes of a batch of records as one array."""

    def __init__(self, column: pa.Array, minimum: int) -> None:
        offsets = binary_offsets(column).astype(np.int64)
        data = column.buffers()[2]
        self.codes = np.frombuffer(data, dtype=np.uint64, count=(offsets[-1] - offsets[0]) // 8, offset=int(offsets[0])) if data else np.zeros(0, dtype=np.uint64)
        self.starts = (offsets[:-1] - offsets[0]) // 8
        self.record = np.repeat(np.arange(len(column)), np.diff(offsets) // 8)
        n = max(len(self.codes) - minimum + 1, 0)
        before = np.concatenate([[0], np.cumsum(self.codes == 0)])
        whole = before[minimum : n + minimum] == before[:n]
        self.ok = whole & (self.record[:n] == self.record[minimum - 1 : n + minimum - 1])
        self.minimum = minimum

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """Position and hash of the minimizer of every window; the rightmost of equal ones."""
        half = self.minimum // 2
        small = _windows(self.codes, half, _BASES[0])
        span = self.minimum - half + 1
        n = len(self.ok)
        best = small[:n].copy()
        at = np.arange(n)
        for k in range(1, span if n else 0):
            other = small[k : n + k]
            take = other <= best
            best = np.where(take, other, best)
            at = np.where(take, np.arange(k, n + k), at)
        return at, best


def _texts(rows: DataFrame, minimum: int) -> tuple[DataFrame, DataFrame]:
    """members (rec, rep) and texts (rep, n_recs, codes): records with equal codes are one text."""
    encoded = materialize(_encoded(rows, minimum), "codes")
    slim = encoded.select("row", "rec", "at", "n", "d1", "d2")
    latest = slim.groupBy("rec").agg(F.max(F.struct(F.col("at").isNotNull(), "at", "n", "d1", "d2", "row")).alias("x"))
    kept = latest.where(F.col("x.n") >= minimum).select("rec", "x.row", "x.d1", "x.d2")
    classes = kept.groupBy("d1", "d2").agg(F.min(F.struct("rec", "row")).alias("first"), F.count("*").alias("n_recs"))
    members = materialize(kept.join(classes, ["d1", "d2"]).select("rec", "row", F.col("first.rec").alias("rep"), F.col("first.row").alias("rep_row"), "n_recs"), "members")
    own = members.select("row", F.when(F.col("row") == F.col("rep_row"), F.col("n_recs")).alias("n_recs"))
    # rows that do not simply stand for one record: superseded ones and copies have 0
    marked = slim.where(F.col("n") >= minimum).select("row").join(own, "row", "left").select("row", F.coalesce("n_recs", F.lit(0)).alias("n_recs")).where("n_recs <> 1")
    marked = materialize(marked, "marked")
    n_recs = F.coalesce("n_recs", F.lit(1))
    texts = encoded.where(F.col("n") >= minimum).join(bounded(marked, marked.count()), "row", "left").where(n_recs > 0)
    return members.select("rec", "rep"), texts.select(F.col("rec").alias("rep"), n_recs.alias("n_recs"), "codes")


def _minimizers(texts: DataFrame, minimum: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_elements(whole, 1)):
            flat = _Flat(batch.column(1), minimum)
            at, best = flat.minimizers()
            at, best = at[flat.ok], best[flat.ok]
            new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=bool)
            reps = batch.column(0).to_numpy()[flat.record[at[new]]]
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(best[new].view(np.int64))], names=["rep", "h"])

    return texts.select("rep", "codes").mapInArrow(run, "rep bigint, h bigint")


def _candidates(texts: DataFrame, minimum: int) -> DataFrame:
    """(rep, pos, a, b, copies) of the windows whose minimizer is in the text's ``seeds``; all windows of texts with copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_elements(whole, 2)):
            flat = _Flat(batch.column(2), minimum)
            _, best = flat.minimizers()
            n = len(flat.ok)
            record = flat.record[:n]
            salt = _mixed(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(1))
            lists = batch.column(3)
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())) if len(lists) else np.zeros(0, int)
            seeds = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ salt[of]
            copies = batch.column(1).to_numpy() > 1
            keep = np.flatnonzero(flat.ok & (np.isin(best ^ salt[record], seeds) | copies[record]))
            a, b = (_windows(flat.codes, minimum, base)[keep].view(np.int64) for base in _BASES)
            own = record[keep]
            pos = (keep - flat.starts[own]).astype(np.int32)
            columns = [batch.column(0).to_numpy()[own], pos, a, b, copies[own]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "pos", "a", "b", "copies"])

    source = texts.select("rep", "n_recs", "codes", F.coalesce("seeds", F.array().cast("array<bigint>")).alias("seeds"))
    return source.mapInArrow(run, "rep bigint, pos int, a bigint, b bigint, copies boolean")


def _repeated(windows: DataFrame) -> DataFrame:
    """Written windows that stand in two texts, or in one that has copies."""
    found = windows.groupBy("a", "b").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), F.max("copies").alias("c"), F.count("*").alias("n"))
    found = materialize(found.where("x <> y or c").select("a", "b", "n"), "repeated")
    every = windows.count()
    heavy = found.where(F.col("n") * HEAVY_PART > every).select("a", "b")
    light = found.where(F.col("n") * HEAVY_PART <= every).select("a", "b")
    columns = ["rep", "pos", "a", "b", "copies"]
    if heavy.isEmpty():
        return windows.join(light, ["a", "b"], "left_semi").select(*columns)
    told = windows.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), ["a", "b"], "left")
    cold = told.where("heavy is null").join(light, ["a", "b"], "left_semi")
    return told.where("heavy").select(*columns).unionByName(cold.select(*columns))


def _grouped(survivors: DataFrame) -> DataFrame:
    """(rep, pos, a, b, copies): the surviving windows of a text as arrays, bounded by its length."""
    lists = survivors.groupBy("rep").agg(F.collect_list(F.struct("pos", "a", "b")).alias("x"), F.max("copies").alias("copies"))
    return lists.select("rep", "x.pos", "x.a", "x.b", "copies")


def _doubled(grouped: DataFrame, width: int) -> DataFrame:
    """Candidates of twice the width: each two neighbouring windows of a text that both survived."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_elements(whole, 1)):
            lists = batch.column(1)
            record = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lambda k: batch.column(k).flatten().to_numpy(zero_copy_only=False)
            key = record * (1 << 33) + flat(1).astype(np.int64)
            order = np.argsort(key)
            key, a, b = key[order], flat(2)[order].view(np.uint64), flat(3)[order].view(np.uint64)
            right = np.searchsorted(key, key + width)
            right[right == len(key)] = 0
            left = np.flatnonzero(key[right] == key + width) if len(key) else np.zeros(0, dtype=np.int64)
            right = right[left]
            one, two = (_mixed(x[left] * base + x[right]).view(np.int64) for x, base in ((a, _BASES[0]), (b, _BASES[1])))
            own = key[left] >> 33
            columns = [batch.column(0).to_numpy()[own], (key[left] & ((1 << 33) - 1)).astype(np.int32), one, two, batch.column(4).to_numpy(zero_copy_only=False)[own]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "pos", "a", "b", "copies"])

    return grouped.mapInArrow(run, "rep bigint, pos int, a bigint, b bigint, copies boolean")


def _runs(width: int):
    """Longest runs of positions covered by windows of ``width`` tokens at the given starts, and the greatest level in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = batch.column(1)
            level_of = np.repeat(np.arange(len(levels)), np.diff(levels.offsets.to_numpy()))
            lens, lists = levels.flatten().flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            record, level = np.repeat(level_of, sizes), np.repeat(lens.to_numpy(zero_copy_only=False), sizes)
            pos = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((pos, record))
            record, pos, level = record[order], pos[order], level[order]
            if not len(pos):
                continue
            new = np.concatenate([[True], (record[1:] != record[:-1]) | (pos[1:] > pos[:-1] + width)])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(pos)]]) - 1
            columns = [batch.column(0).to_numpy()[record[first]], pos[first].astype(np.int32), (pos[last] + width - pos[first]).astype(np.int32), np.maximum.reduceat(level, first).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "start_pos", "n_tokens", "repeated_len"])

    return run


def _as_rows(df: DataFrame, is_reference: bool, at: Column) -> DataFrame:
    """Records of the corpus have even numbers, those of the reference odd ones: equal ids never meet."""
    return df.select((F.col("doc_idx") * 2 + int(is_reference)).alias("rec"), at.cast("timestamp_ntz").alias("at"), F.col("tokens").cast("array<string>").alias("tokens"))


def shared_spans(tokenized: DataFrame, reference: DataFrame | None = None, minimum: int = MIN_TOKENS) -> DataFrame:
    """(doc_idx, start_pos, n_tokens, repeated_len) of the shared runs of each record.

    A run is a longest stretch of positions, each of which lies in ``minimum``
    consecutive tokens that stand in another record too.  ``repeated_len`` is
    the greatest length minimum * 2^k of a single repeated window in the run.
    """
    rows = _as_rows(tokenized, False, F.col("tokenized_at"))
    if reference is not None:
        rows = rows.unionByName(_as_rows(reference, True, F.lit(None)))
    members, texts = _texts(rows, minimum)
    small = materialize(_minimizers(texts, minimum), "minimizers")
    seeds = small.groupBy("h").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("h")
    per_text = small.join(seeds, "h", "left_semi").groupBy("rep").agg(F.collect_set("h").alias("seeds"))
    wanted = texts.join(per_text, "rep", "left").where("n_recs > 1 or seeds is not null")
    windows, width, levels = materialize(_candidates(wanted, minimum), "windows"), minimum, []
    discard(small)
    while True:
        grouped = materialize(_grouped(_repeated(windows)), "level")
        discard(windows)
        if levels and grouped.isEmpty():
            break
        levels.append(grouped.select("rep", F.struct(F.lit(width).alias("len"), "pos").alias("level")))
        windows, width = materialize(_doubled(grouped, width), "windows"), width * 2
        if windows.isEmpty():
            break
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    runs = every.groupBy("rep").agg(F.collect_list("level").alias("levels")).mapInArrow(_runs(minimum), "rep bigint, start_pos int, n_tokens int, repeated_len int")
    out = members.where(F.col("rec") % 2 == 0).join(runs, "rep")
    return out.select((F.col("rec") / 2).cast("bigint").alias("doc_idx"), "start_pos", "n_tokens", "repeated_len")


def shared_share(tokenized: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_idx, n_tokens, n_shared, share): how much of every record is shared elsewhere; 0 where nothing is."""
    size = F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0))
    sizes = tokenized.where(F.col("doc_idx").isNotNull()).groupBy("doc_idx").agg(F.max_by(size, F.struct(F.col("tokenized_at").isNotNull(), "tokenized_at")).alias("n_tokens"))
    shared = spans.groupBy("doc_idx").agg(F.sum("n_tokens").alias("n_shared"))
    n = F.coalesce("n_shared", F.lit(0))
    return sizes.join(shared, "doc_idx", "left").select("doc_idx", "n_tokens", n.alias("n_shared"), F.when(F.col("n_tokens") > 0, n / F.col("n_tokens")).otherwise(0.0).alias("share"))
