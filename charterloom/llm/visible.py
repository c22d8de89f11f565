"""One form for text that looks the same (problem 1).

A mapping from what is stored to what is seen is computed once: by rule from
the Unicode database, from the public confusables data that Spark ships with
ICU for scripts whose letters are drawn like Latin ones (Cherokee, Lisu, Coptic
and others), and from a short table of the look-alikes of Greek, Cyrillic,
Armenian and Latin, where the public data also holds letters that a reader can
tell apart (such as Greek alpha).  It is checked for conflicts and compiled
into one pattern.  The pattern walks a text once over
grapheme clusters and takes the longest match: a run of white space and
invisible characters, a base letter with everything that combines with it, or
a single mapped character.  Ordinary characters are never touched, so plain
text costs a scan.

What counts as seen: letters, case, accents, raised digits and letter forms
(a long s stays a long s).  What does not: widths, joined letters (ligatures,
Arabic presentation forms), invisible characters, the kind and number of white
space characters, the order and composition of accents, and which script a
look-alike letter comes from.  The form is therefore a comparison form: a
Cyrillic letter that looks Latin becomes Latin wherever it stands.

Null gives null, texts that show nothing give the empty string.  Rows are
mapped one by one; repeated rows stay repeated.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charterloom.functions.batches import by_bytes
from charterloom.plans.materialize import materialize

BLOCK_ROWS = 1000

#: Letters and marks that look like the character before the colon.
LOOK_ALIKES = """
A:ΑА B:ΒВ C:СϹ E:ΕЕ F:Ϝ G:Ԍ H:ΗН I:ΙІӀ J:ЈͿ K:ΚК M:ΜМ N:Ν O:ΟОՕ P:ΡР Q:Ԛ S:ЅՏ T:ΤТ U:Ս V:Ѵ W:Ԝ X:ΧХ Y:ΥҮ Z:Ζ
a:аɑ c:сϲ d:ԁ e:е g:ɡց h:һհ i:і j:јϳ l:ӏ n:ո o:оοօ p:рρ q:ԛզ s:ѕ u:ս v:νѵ w:ԝ x:х y:уү
ä:ӓ æ:ӕ ə:ә þ:ϸ μ:µ Π:П Γ:Г Φ:Ф
-:‐‑ ::∶꞉ /:⁄∕ |:ǀ !:ǃ
"""

_WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Characters that are blank by definition though not of the format category.
_BLANK = "".join(map(chr, (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))))
#: Format characters that are drawn.
_DRAWN = frozenset(map(chr, (*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD)))
#: Compatibility kinds that change no visible shape; plain <compat> is judged by its letters.
_SHAPELESS = ("<wide>", "<narrow>", "<small>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")
_ROMAN = range(0x2160, 0x2180)
_IDEOGRAPHS = range(0x2F800, 0x2FA20)  # compatibility ideographs


#: Half-width sound marks, which combine once their width is normal.
_HALF_MARKS = chr(0xFF9E) + chr(0xFF9F)


#: Scripts whose letters are drawn like Latin ones, by the first word of their character names.
LATIN_SHAPED = frozenset("CARIAN CHEROKEE COPTIC DESERET ELBASAN LISU LYCIAN OLD OSAGE WARANG".split())


class Conflict(ValueError):
    """Two rules of the mapping contradict each other."""


def look_alikes() -> dict[str, str]:
    """Look-alike character to its representative."""
    out: dict[str, str] = {}
    for entry in LOOK_ALIKES.split():
        target, _, sources = entry.partition(":") if entry[0] != ":" else (":", ":", entry[2:])
        for source in sources:
            if source == target:
                continue
            if out.setdefault(source, target) != target:
                raise Conflict(f"{source!r} looks like both {out[source]!r} and {target!r}")
    return out


def confusable_letters(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """(letter, Latin letter that it is drawn like) of the ``LATIN_SHAPED`` scripts, from the confusables data of the JVM's ICU.

    That data has one sign for capital I and small l; letters that are no small ones are drawn like I.
    """
    letters = [c for c in map(chr, (*range(0x80, 0xD800), *range(0xF900, 0x20000))) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and unicodedata.name(c, "").split(" ")[0] in LATIN_SHAPED]
    checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    out = []
    for ch, shown in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True):
        small = unicodedata.category(ch) == "Ll"
        shown = "I" if shown == "l" and not small else shown
        if len(shown) == 1 and shown.isascii() and shown.isalpha() and (shown.islower() or not small):
            out.append((ch, shown))
    return tuple(out)


def _by_rule(ch: str) -> str | None:
    """What a compatibility character shows, if it is only another width, joining or spacing."""
    kind, *codes = unicodedata.decomposition(ch).split() or [""]
    if not kind.startswith("<"):
        return None
    shown = "".join(chr(int(c, 16)) for c in codes)
    letters = sum(c.isalpha() for c in shown)
    joined = kind == "<compat>" and (ord(ch) in _ROMAN or (len(shown) > 1 and letters == len(shown) and ch.isalpha()))
    dots = kind == "<compat>" and shown and set(shown) == {"."}
    return shown if kind in _SHAPELESS or joined or dots else None


def build_mapping(confusable: tuple[tuple[str, str], ...] = ()) -> dict[str, str]:
    """Single character to the string shown for it, closed under itself; ``confusable`` adds pairs to the table.

    Every target is a fixed point of the mapping and of canonical composition,
    else :class:`Conflict` is raised; so the form is the same however often it
    is taken.
    """
    raw = {chr(c): s for c in (*range(0x80, 0xD800), *range(0xF900, 0x20000), *_IDEOGRAPHS) if (s := _by_rule(chr(c))) is not None}
    alike = look_alikes()
    for source, target in confusable:
        if alike.setdefault(source, target) != target:
            raise Conflict(f"{source!r} looks like both {alike[source]!r} and {target!r}")
    for source, target in alike.items():
        if raw.get(source, target) != target and len(raw[source]) > 1:
            raise Conflict(f"{source!r} is both {raw[source]!r} and {target!r}")
        raw[source] = target
    for code in (*range(0xC0, 0xD800), *range(0xF900, 0x20000), *_IDEOGRAPHS):  # composed letters follow their base letter
        parts = unicodedata.normalize("NFD", chr(code))
        shown = unicodedata.normalize("NFC", "".join(raw.get(c, c) for c in parts))
        if shown != chr(code):
            raw.setdefault(chr(code), shown)
    closed: dict[str, str] = {}
    for source, shown in raw.items():
        for _ in range(8):
            step = unicodedata.normalize("NFC", "".join(raw.get(c, c) for c in shown))
            if step == shown:
                break
            shown = step
        else:
            raise Conflict(f"the mapping of {source!r} does not settle")
        if shown != source and source not in _WHITE:
            closed[source] = shown
    for source, shown in closed.items():
        if any(c in closed for c in shown):
            raise Conflict(f"{source!r} maps to {shown!r}, which is mapped again")
    return closed


class _Clusters(dict):
    """Cluster to what it shows, filled on demand; long clusters are not kept, and it starts anew when full."""

    def __init__(self, shown) -> None:
        super().__init__()
        self.shown = shown

    def __missing__(self, found: str) -> str:
        out = self.shown(found)
        if len(found) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[found] = out
        return out


def second_parts(characters: list[str]) -> set[str]:
    """What stands second in a canonical composition of ``characters``, combining class 0 included."""
    parts = {c: unicodedata.decomposition(c).split() for c in characters}
    pairs = {c: "".join(chr(int(x, 16)) for x in p) for c, p in parts.items() if len(p) == 2 and p[0][0] != "<"}
    return {p[1] for c, p in pairs.items() if unicodedata.normalize("NFC", p) == c}


class VisibleForm:
    """The compiled transducer."""

    def __init__(self, confusable: tuple[tuple[str, str], ...] = ()) -> None:
        self.mapping = build_mapping(confusable)
        every = [chr(c) for c in (*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200))]
        hidden = {c for c in every if unicodedata.category(c) == "Cf" and c not in _DRAWN} | set(_BLANK)
        hidden |= {chr(c) for c in (*range(0x00, 0x09), *range(0x0E, 0x1C), 0x7F)}
        hidden -= set(_WHITE)
        # marks, and what is made of marks only, as U+0F73
        marks = {c for c in every if unicodedata.combining(unicodedata.normalize("NFD", c)[0]) or c in _HALF_MARKS}
        marks = (marks | second_parts(every)) - hidden
        self.white, self.hidden = frozenset(_WHITE), frozenset(hidden)
        w, h, m, x = (_char_class(s) for s in (_WHITE, hidden, marks, set(self.mapping) - marks))
        odd_white = _char_class(set(_WHITE) - {" "})
        jamo = _char_class(map(chr, range(0x1100, 0x1200)))
        blank = f"[{odd_white}{h}][{w}{h}]*|[ ][{w}{h}]+"  # white space and what is not seen
        cluster = f"[{jamo}][{jamo}{h}]*|[^{w}{h}{m}][{h}]*[{m}][{m}{h}]*"  # a letter and what combines with it
        self.split = re.compile(f"({blank}|{cluster}|[{x}]|[{m}][{m}{h}]*)").split
        # the same rules without those that cannot match in a text that has nothing to combine
        self.split_plain = re.compile(f"({blank}|[{x}])").split
        self.combines = re.compile(f"[{m}{jamo}]").search
        self.memo = _Clusters(self._shown)

    def _shown(self, found: str) -> str:
        if any(c in self.white for c in found):
            return " "
        seen = "".join(self.mapping.get(c, c) for c in found if c not in self.hidden)
        composed = unicodedata.normalize("NFC", seen)
        return "".join(self.mapping.get(c, c) for c in composed)

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        parts = (self.split if self.combines(text) else self.split_plain)(text)
        parts[1::2] = map(self.memo.__getitem__, parts[1::2])
        shown = "".join(parts)
        if "  " in shown:  # invisible characters between two runs of white space
            shown = re.sub("  +", " ", shown)
        return shown.strip(" ")


def _char_class(chars) -> str:
    """Body of a character class with ranges."""
    codes, out, k = sorted(map(ord, chars)), [], 0
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(re.escape(chr(codes[k])) + ("-" + re.escape(chr(codes[j])) if j > k else ""))
        k = j + 1
    return "".join(out)


@lru_cache(maxsize=2)
def visible_form(confusable: tuple[tuple[str, str], ...] = ()) -> VisibleForm:
    return VisibleForm(confusable)


def normalize_visible(df: DataFrame, key: str = "doc_idx", text: str = "text") -> DataFrame:
    """(key, text): every text in its visible form.  A map over the scan; nothing is shuffled."""
    confusable = confusable_letters(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = visible_form(confusable)
        for batch in by_bytes(batches):
            shown = pa.array([form(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), shown], names=[key, "text"])

    source = df.select(F.col(key), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, text string")


def form_keys(df: DataFrame, key: str, text: str, at: str) -> DataFrame:
    """(key, at, form, stored): 128-bit keys of the visible form and of the stored text; texts that show nothing are left out."""
    confusable = confusable_letters(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, digest = visible_form(confusable), xxhash.xxh3_128_digest
        for batch in by_bytes(batches):
            keep, forms, stored = [], [], []
            for k, t in enumerate(batch.column(2).to_pylist()):
                if t and (shown := form(t)):
                    keep.append(k)
                    forms.append(digest(shown.encode("utf-8", "replace")))
                    stored.append(digest(t.encode("utf-8", "replace")))
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(forms, pa.binary()), pa.array(stored, pa.binary())], names=["key", "at", "form", "stored"])

    source = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(text).cast("string").alias("text"))
    kinds = [source.schema[c].dataType.simpleString() for c in ("key", "at")]
    return source.mapInArrow(run, f"key {kinds[0]}, at {kinds[1]}, form binary, stored binary")


def look_same_groups(df: DataFrame, key: str = "doc_idx", text: str = "text", at: str = "loaded_at") -> DataFrame:
    """(key, form, stored) of the records whose form is shared by a differently stored text.

    A record is one key: its latest row holds.  Only keys and digests are
    shuffled.  Texts stored alike are first combined to classes, so a group of
    copies, however large, is one row when forms are compared.
    """
    rows = form_keys(df, key, text, at).groupBy("key").agg(F.max(F.struct("at", "form", "stored")).alias("x"))
    rows = materialize(rows.select("key", "x.form", "x.stored"), "forms")
    mixed = rows.groupBy("form").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a <> b").select("form")
    return rows.join(mixed, "form", "left_semi").select(F.col("key").alias(key), "form", "stored")


def look_same_members(df: DataFrame) -> DataFrame:
    """(doc_idx, class_id, group_id) of the records that look like a differently stored one.

    ``class_id`` is the smallest record stored alike, ``group_id`` the smallest
    one that looks the same, so (class_id, group_id) are the pairs of
    representatives.  Linear in the records, however many look the same.
    """
    rows = look_same_groups(df)
    classes = rows.groupBy("form", "stored").agg(F.min("doc_idx").alias("class_id"))
    firsts = classes.groupBy("form").agg(F.min("class_id").alias("group_id"))
    return rows.join(classes.join(firsts, "form"), ["form", "stored"]).select("doc_idx", "class_id", "group_id")


def look_same_pairs(df: DataFrame) -> DataFrame:
    """(doc_idx_a, doc_idx_b), a < b: records that look the same though stored differently.

    The pairs of a form are those between different classes of stored texts;
    pairs of exact copies are never made.  The records of a form are split
    into blocks of about ``BLOCK_ROWS``, each joined apart, so a form of a
    third of all records is many tasks' work.
    """
    rows = materialize(look_same_groups(df), "alike")
    blocks = rows.groupBy("form").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = rows.join(blocks, "form")
    a = rows.select("form", F.pmod(F.xxhash64("doc_idx"), "blocks").cast("int").alias("block"), F.col("doc_idx").alias("doc_idx_a"), F.col("stored").alias("sa"))
    b = rows.select("form", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("doc_idx").alias("doc_idx_b"), F.col("stored").alias("sb"))
    return a.join(b, ["form", "block"]).where("sa <> sb and doc_idx_a < doc_idx_b").select("doc_idx_a", "doc_idx_b")
