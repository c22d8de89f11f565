"""Encoding a corpus with a public byte-level BPE vocabulary (problem 6).

Two tiers.  A pre-token that is itself in the vocabulary is resolved by a
minimal perfect hash over the vocabulary's byte strings (the stored key is
compared, so a foreign string can never be taken for an entry).  Anything else
is merged by rank with a heap over doubly linked bytes, O(n log n) in its
length, so a run of 60,000 letters is no problem.  Python workers keep a
bounded memo of pre-tokens, since word frequencies are strongly skewed.

The stage is a plain map over the scan: no shuffle, and the broadcast state
has the size of the vocabulary, whatever the data.

Null and empty texts both give the empty list.  Strings that look like special
tokens are ordinary text.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charterloom.functions.batches import by_bytes

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: The split pattern of the vocabulary's family, with Unicode white space spelt out (fixed value).
_SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PRE_TOKENS = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|["
    + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+"
)

_GOLDEN, _M32 = 0x9E3779B1, 0xFFFFFFFF
#: Entries of a memo, and the longest pre-token kept in one, which together bound its memory.
_MEMO_LIMIT, _MEMO_LONGEST = 200_000, 64


def _byte_alphabet() -> dict[str, int]:
    """Stand-in characters of the 256 bytes in byte-level vocabularies (fixed values)."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


class PerfectHash:
    """Minimal perfect hash of byte strings by displacement of buckets.

    Keys fall into n/4 buckets by the high half of a 64-bit hash.  Buckets are
    placed from the largest on, each with the first displacement that sends
    all its keys to free slots; single keys then take the remaining slots.
    """

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) < n:
            raise ValueError("keys must be distinct")
        home = ((hashes >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        low = hashes & np.uint64(_M32)
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        slot_of = np.full(n, -1, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        tries = np.arange(64, dtype=np.uint64)[:, None]
        placed = np.argsort(-sizes, kind="stable")
        singles = []
        for b in placed[: int((sizes > 0).sum())].tolist():
            members = order[starts[b] : starts[b + 1]]
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            first = 0
            while True:
                slots = self._slots(low[members][None, :], tries + np.uint64(first))
                good = free[slots].all(axis=1)
                for t in np.flatnonzero(good).tolist():
                    if len(set(row := slots[t].tolist())) == len(row):
                        break
                else:
                    first += len(tries)
                    continue
                self.shift[b] = first + t
                slot_of[members] = slots[t]
                free[slots[t]] = False
                break
        for (b, member), slot in zip(singles, np.flatnonzero(free).tolist(), strict=True):
            self.shift[b] = -slot - 1
            slot_of[member] = slot
        by_slot = np.argsort(slot_of)
        self.keys = [keys[k] for k in by_slot.tolist()]
        self.values = [values[k] for k in by_slot.tolist()]

    def _slots(self, low: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = (low ^ (shift * np.uint64(_GOLDEN))) & np.uint64(_M32)
        x = ((x ^ (x >> np.uint64(15))) * np.uint64(0x2C1B3C6D)) & np.uint64(_M32)
        return ((x ^ (x >> np.uint64(12))) * np.uint64(self.n)) >> np.uint64(32)

    def prepare(self) -> None:
        """Plain lists for scalar lookups in a worker."""
        self.shifts = self.shift.tolist()

    def get(self, key: bytes) -> int:
        """Value of ``key``, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shifts[((h >> 32) * self.buckets) >> 32]
        if d < 0:
            slot = -d - 1
        else:
            x = ((h & _M32) ^ (d * _GOLDEN)) & _M32
            x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & _M32
            # the wide product of the builder wraps at 64 bits only beyond 2^32 slots
            slot = ((x ^ (x >> 12)) * self.n) >> 32
        return self.values[slot] if slot < self.n and self.keys[slot] == key else -1


class Memo(dict):
    """Pre-token to ids; misses are computed, long ones are not kept, and the memo starts anew when full."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, token: str):
        out = self.encode(token)
        if len(token) <= _MEMO_LONGEST:
            if len(self) >= _MEMO_LIMIT:
                self.clear()
            self[token] = out
        return out


class ByteBpe:
    """The encoder: vocabulary, merges and the perfect hash; made on the driver, broadcast to workers."""

    def __init__(self, path: str = DEFAULT_VOCABULARY) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        stand_in = _byte_alphabet()
        raw = {t: bytes(stand_in[c] for c in t) for t in model["vocab"] if all(c in stand_in for c in t)}
        vocab = model["vocab"]
        self.hash = PerfectHash(list(raw.values()), [vocab[t] for t in raw])
        self.byte_ids = [vocab[c] for c, _ in sorted(stand_in.items(), key=lambda x: x[1])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int32)
        self.ready = False

    def prepare(self) -> ByteBpe:
        if not self.ready:
            self.hash.prepare()
            self.ranks = {(a, b): (r, c) for r, (a, b, c) in enumerate(self.merges.tolist())}
            self.split = regex.compile(PRE_TOKENS).findall
            self.memo, self.counts = Memo(self.token_ids), Memo(lambda t: len(self.token_ids(t)))
            self.ready = True
        return self

    def token_ids(self, token: str) -> tuple[int, ...]:
        data = token.encode("utf-8", "replace")
        whole = self.hash.get(data)
        return (whole,) if whole >= 0 else self.merged(data)

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Merge by lowest rank, leftmost first, with a heap over linked bytes."""
        ids = [self.byte_ids[b] for b in data]
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], k, ids[k], ids[k + 1], r[1]) for k in range(n - 1) if (r := ranks.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[k], ids[j] = new, -1
            after[k] = nxt = after[j]
            if nxt < n:
                before[nxt] = k
                if r := ranks.get((new, ids[nxt])):
                    heapq.heappush(heap, (r[0], k, new, ids[nxt], r[1]))
            if (p := before[k]) >= 0 and (r := ranks.get((ids[p], new))):
                heapq.heappush(heap, (r[0], p, ids[p], new, r[1]))
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(self.counts.__getitem__, self.split(text))) if text else 0


@lru_cache(maxsize=4)
def load(path: str = DEFAULT_VOCABULARY) -> ByteBpe:
    return ByteBpe(path)


def _broadcast(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(load(path))


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row of ``df``; other columns are left out.

    Null and empty texts have the empty list; repeated rows stay repeated; an
    empty table gives an empty result.
    """
    shared = _broadcast(df, path)
    source = df.select(F.col(key), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value.prepare()
        for part in by_bytes(batches):
            rows = [bpe.encode(t) for t in part.column(1).to_pylist()]
            ends = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) for r in rows], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str = DEFAULT_VOCABULARY, size: str = "n_tokens") -> DataFrame:
    """``keep`` columns and the number of tokens of each row; null and empty texts have 0."""
    shared = _broadcast(df, path)
    source = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value.prepare()
        for batch in by_bytes(batches):
            sizes = pa.array([bpe.count(t) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes], names=[*keep, size])

    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{kinds}, `{size}` bigint")
