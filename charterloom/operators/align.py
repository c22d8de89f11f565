"""Alignment of document pairs: matching blocks, gaps, variants and highlighted text."""

from __future__ import annotations

import difflib
import html
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from charterloom.functions.batches import by_bytes
from charterloom.functions.text import alnum_tokens, fuzzy_ratio, year_of

SIMILAR, DIFFERENT = "Similar Bridge Word", "Different Bridge Word"
LONG_MATCH = 4

#: Words with inner apostrophes, hyphens or points; numbers; single marks.
_TOKEN = re.compile(r"\w+(?:[-'’]\w+)*|\.\.\.|[^\w\s]")
_PAIR = "array<struct<a:int,b:int,size:int>>"
_ALNUM = re.compile(r"[^\W_]+").fullmatch

#: A document of more than one of so many pairs is hot; its text is joined in so many parts of its pairs.
HOT_PART, SALTS = 200, 32


def token_spans(text: str | None) -> list[tuple[int, int]]:
    """Display tokens as offsets into the original text, so that a run of tokens can be cut out of it unchanged."""
    return [m.span() for m in _TOKEN.finditer(text or "")]


def display_tokens(text: str | None) -> list[str]:
    return [m[0] for m in _TOKEN.finditer(text or "")]


def blocks_of(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Matching blocks by longest-block recursion, with the closing block of size 0."""
    return [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()]


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b); 1 for two empty strings."""
    if not a and not b:
        return 1.0
    row = [0] * (len(a) + 1)
    for ch in b:
        last = 0
        for k, x in enumerate(a, 1):
            last, row[k] = row[k], last + 1 if x == ch else max(row[k], row[k - 1])
    return 2.0 * row[-1] / (len(a) + len(b))


@F.pandas_udf(T.ArrayType(T.StringType()))
def display_tokens_udf(text: pd.Series) -> pd.Series:
    return text.map(display_tokens)


def with_display_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``words``, its display tokens."""
    return docs.withColumn("words", display_tokens_udf(F.col(text)))


def pair_documents(pairs: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Both documents of each pair as ``c1`` and ``c2`` for each column ``c``; only documents that occur are joined.

    A document that stands in more than one of ``HOT_PART`` pairs, of which
    there are at most ``HOT_PART`` on a side, is copied ``SALTS`` times, and
    its pairs are spread over the copies.
    """
    n = pairs.count()
    for side, end, other in ((1, "i", "j"), (2, "j", "i")):
        hot = pairs.groupBy(end).agg(F.count("*").alias("_n")).where(F.col("_n") * HOT_PART > n).select(end, F.lit(SALTS).alias("_salts"))
        hot = F.broadcast(hot)
        salts = F.coalesce("_salts", F.lit(1))
        own = docs.select(F.col("doc_idx").alias(end), *[F.col(c).alias(f"{c}{side}") for c in columns]).join(hot, end, "left")
        own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        spread = pairs.join(hot, end, "left").withColumn("_salt", F.pmod(F.hash(other), salts)).drop("_salts")
        pairs = spread.join(own, [end, "_salt"]).drop("_salt")
    return pairs


def align(pairs: DataFrame, docs: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(i, j, score, t1, t2, blocks) of each pair; pairs with a side without tokens are left out.

    Words are lower-cased tokens of letters and digits, or with
    ``case_sensitive`` all display tokens as they stand.
    """
    words = F.col("words") if case_sensitive else F.transform(alnum_tokens(F.col("words")), F.lower)
    prepared = with_display_tokens(docs).select("doc_idx", words.alias("t"))
    both = pair_documents(pairs.select("i", "j", "score"), prepared, ["t"]).where("size(t1) > 0 and size(t2) > 0")

    def run(batches):
        for batch in by_bytes(batches):
            a, b = batch.column("t1").to_pylist(), batch.column("t2").to_pylist()
            found = [[{"a": x, "b": y, "size": n} for x, y, n in blocks_of(s, t)] for s, t in zip(a, b, strict=True)]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("size", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("i", "j", "score", "t1", "t2")), pa.array(found, kind)], names=["i", "j", "score", "t1", "t2", "blocks"])

    return both.select("i", "j", "score", "t1", "t2").mapInArrow(run, f"i bigint, j bigint, score double, t1 array<string>, t2 array<string>, blocks {_PAIR}")


def matching_blocks(aligned: DataFrame) -> DataFrame:
    """(i, j, seq, a, b, size), the closing block included."""
    return aligned.select("i", "j", F.posexplode("blocks").alias("seq", "x")).select("i", "j", "seq", "x.a", "x.b", "x.size")


def gaps(aligned: DataFrame) -> DataFrame:
    """(i, j, seq, gap1, gap2): the tokens between each block and the one before it; what follows the last block is none.

    A gap needs only its neighbour in the array, so nothing is sorted or shuffled.
    """
    before = F.expr("transform(blocks, (x, k) -> named_struct('a', if(k = 0, 0, blocks[k - 1].a + blocks[k - 1].size), 'b', if(k = 0, 0, blocks[k - 1].b + blocks[k - 1].size)))")
    rows = aligned.withColumn("before", before).select("i", "j", "t1", "t2", F.posexplode(F.arrays_zip("blocks", "before")).alias("seq", "z"))
    size = F.col("z.blocks.size")
    return rows.where(size > 0).select(
        "i", "j", "seq",
        F.expr("slice(t1, z.before.a + 1, z.blocks.a - z.before.a)").alias("gap1"),
        F.expr("slice(t2, z.before.b + 1, z.blocks.b - z.before.b)").alias("gap2"),
    )


def short_gaps(found: DataFrame, max_gap: int = 5) -> DataFrame:
    """Gaps with a short side: one side of 1 to ``max_gap`` tokens is enough."""
    return found.where(F.size("gap1").between(1, max_gap) | F.size("gap2").between(1, max_gap))


@F.pandas_udf(T.DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in memo:
            memo[pair] = indel_ratio(*pair)
        out.append(memo[pair])
    return pd.Series(out, dtype=float)


def variations(found: DataFrame, fuzz: float = 0.75, max_gap: int = 5) -> DataFrame:
    """(i, j, seq, pos, variation_type, token_1, token_2) of the short gaps.

    Gaps of equal length pair their tokens in order; of others every token
    stands alone against ``-``, the left ones first.
    """
    rows = short_gaps(found, max_gap)
    equal = rows.where(F.size("gap1") == F.size("gap2")).select("i", "j", "seq", F.posexplode(F.arrays_zip(F.col("gap1").alias("x"), F.col("gap2").alias("y"))).alias("pos", "z"))
    paired = equal.select("i", "j", "seq", "pos", F.when(indel_ratio_udf("z.x", "z.y") >= fuzz, SIMILAR).otherwise(DIFFERENT).alias("variation_type"), F.col("z.x").alias("token_1"), F.col("z.y").alias("token_2"))
    left = F.transform("gap1", lambda t: F.struct(t.alias("x"), F.lit("-").alias("y")))
    right = F.transform("gap2", lambda t: F.struct(F.lit("-").alias("x"), t.alias("y")))
    alone = rows.where(F.size("gap1") != F.size("gap2")).select("i", "j", "seq", F.posexplode(F.concat(left, right)).alias("pos", "z"))
    return paired.unionByName(alone.select("i", "j", "seq", "pos", F.lit(DIFFERENT).alias("variation_type"), F.col("z.x").alias("token_1"), F.col("z.y").alias("token_2")))


def long_segments(pairs: DataFrame, docs: DataFrame, longer_than: int = LONG_MATCH) -> DataFrame:
    """(doc_idx, segment): distinct stretches of more than four display tokens that a document shares with a partner.

    Tokens are compared as they stand; a segment is cut out of the document's
    own text by offsets.
    """
    both = pair_documents(pairs.select("i", "j"), docs, ["text"]).select("i", "j", "text1", "text2")

    def run(batches):
        for batch in by_bytes(batches):
            owners, segments = [], []
            for i, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = token_spans(a)
                for x, _, n in blocks_of(display_tokens(a), display_tokens(b)):
                    if n > longer_than:
                        owners.append(i)
                        segments.append(" ".join(a[spans[x][0] : spans[x + n - 1][1]].split()))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(segments, pa.string())], names=["doc_idx", "segment"])

    return both.select("i", "text1", "text2").mapInArrow(run, "doc_idx bigint, segment string").distinct()


def chronological(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(i, j, score, first, second, year_first, year_second): the earlier document first, equal years in pair order."""
    named = docs.select("doc_idx", year_of(F.coalesce("name", F.lit(""))).alias("year"))
    rows = pair_documents(pairs.select("i", "j", "score"), named, ["year"])
    swap = F.col("year1") > F.col("year2")
    side = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return rows.select("i", "j", "score", side("i", "j").alias("first"), side("j", "i").alias("second"), side("year1", "year2").alias("year_first"), side("year2", "year1").alias("year_second"))


def _join_words(words: list[str]) -> str:
    """Words with the usual spacing: none before closing marks or after opening ones."""
    return re.sub(r"([(\[«„]) ", r"\1", re.sub(r" ([.,;:!?)\]»”…])", r"\1", " ".join(words)))


def _bridge(sides: list[list[str]], max_gap: int, fuzz: float) -> list[str]:
    """Markup of both sides of a gap: bridge words with their likeness if the gap is short and holds a word."""
    plain = [_join_words(side) for side in sides]
    counts = [sum(_ALNUM(w) is not None for w in side) for side in sides]
    if max(counts) > max_gap or not any(counts):
        return [html.escape(text) for text in plain]
    ratio = indel_ratio(*(text.lower() for text in plain))
    span = f'<span class="bridge-words"><span class="dynamic-bridge-word is-{"similar" if ratio >= fuzz else "dissimilar"}" data-fuzz="{ratio:.3f}">'
    return [f"{span}{html.escape(text)}</span></span>" for text in plain]


def _match(words: list[str]) -> str:
    """Escaped words of a match with their punctuation marked."""
    return re.sub(r"([^\w\s&;#]|&(?:amp|lt|gt|quot|#x27);)", r'<span class="punct-in-match">\1</span>', html.escape(_join_words(words)))


def highlight(text1: str, text2: str, pair_id: str, max_gap: int = 5, fuzz: float = 0.75) -> tuple[str, str, int]:
    """Both texts with matched stretches and short gaps marked up, and the number of matches.  Text is escaped.

    Matches split each text into one gap more than there are matches; the last
    gap is never marked up.
    """
    words = [display_tokens(text) for text in (text1, text2)]
    places = [[k for k, w in enumerate(side) if _ALNUM(w)] for side in words]
    found = blocks_of(*([side[k].lower() for k in at] for side, at in zip(words, places, strict=True))) if all(places) else []
    # display-token ranges of the matches on each side
    ranges = [[(at[block[s]], at[block[s] + block[2] - 1] + 1) for block in found if block[2]] for s, at in enumerate(places)]
    holes = [list(zip([0, *(b for _, b in side)], [*(a for a, _ in side), len(words[s])], strict=True)) for s, side in enumerate(ranges)]
    gaps_ = [[words[s][a:b] for a, b in side] for s, side in enumerate(holes)]
    bridges = [_bridge(list(pair), max_gap, fuzz) for pair in list(zip(*gaps_, strict=True))[:-1]] + [[html.escape(_join_words(side[-1])) for side in gaps_]]
    out = []
    for s, kind in enumerate(("highlight clickable", "match-text")):
        matches = [f'<span class="{kind}" data-pair-id="{pair_id}" data-match-id="{k}">{_match(words[s][a:b])}</span>' for k, (a, b) in enumerate(ranges[s])]
        parts = [x for bridge, match in zip([b[s] for b in bridges], [*matches, ""], strict=True) for x in (bridge, match)]
        out.append(" ".join(filter(None, parts)))
    return out[0], out[1], len(ranges[0])


def highlighted_pairs(pairs: DataFrame, docs: DataFrame, max_gap: int = 5, fuzz: float = 0.75) -> DataFrame:
    """(i, j, score, name1, name2, html1, html2, n_matches) with the earlier document on the left."""
    order = chronological(pairs, docs).select("i", "j", "score", "first", "second")
    own = docs.select("doc_idx", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    rows = order.join(own.toDF("first", "name1", "text1"), "first").join(own.toDF("second", "name2", "text2"), "second")

    def run(batches):
        for batch in by_bytes(batches):
            rows = batch.to_pylist()
            found = [highlight(r["text1"], r["text2"], f"{r['i']}-{r['j']}", max_gap, fuzz) for r in rows]
            columns = [*(batch.column(c) for c in ("i", "j", "score", "name1", "name2")), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1)), pa.array([f[2] for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "score", "name1", "name2", "html1", "html2", "n_matches"])

    return rows.select("i", "j", "score", "name1", "name2", "text1", "text2").mapInArrow(run, "i bigint, j bigint, score double, name1 string, name2 string, html1 string, html2 string, n_matches int")


def bridge_classes(pairs_of_words: DataFrame, fuzz: float = 0.75) -> DataFrame:
    """(token_1, token_2, ratio, kind) by the JVM-side ratio."""
    ratio = fuzzy_ratio(F.col("token_1"), F.col("token_2"))
    return pairs_of_words.select("token_1", "token_2", ratio.alias("ratio")).withColumn("kind", F.when(F.col("ratio") >= fuzz, "is-similar").otherwise("is-dissimilar"))
