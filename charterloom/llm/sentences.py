"""Sentence boundaries across languages and scripts (problem 8).

A semi-Markov model: a document is a row of spans, and dynamic programming
over all candidate boundaries picks the spans with the greatest total score.
The score of a span is the sum of

* opening: what the span begins with (kind of letter, words that open
  sentences, a list bullet, a place within a quotation),
* closing: what it ends with (the mark, the word before it, the kind of line
  break, a place within a quotation),
* joint terms, never positive, that depend on both ends: spans of one or two
  words and very long ones, a list number alone, a line without a final mark
  that is neither list line nor heading, and a bracket or a quotation in a
  script without case that closes a span which it does not open.

Word lists and marks are graded features of these sums, none is a verdict.
Candidates are sentence marks with what closes after them, line breaks, and
the spaces of scripts that write no sentence mark; a mark within a word or
number (3.14, kartular.example) is none.

For the span that ends at a candidate the earlier starts are looked at from
the nearest on.  A start is left out if an earlier one beats it for every end,
its greater length included, and the search ends where the best total before a
start, less the cost of the length reached, cannot beat what was found; as
joint terms are never positive, neither loses anything.  Equal totals go to the
fewer spans.

Offsets are code points, 0-based, end exclusive, without white space or byte
order marks around a sentence.  Null, empty and blank texts have no sentences.
Rows are processed one by one; repeated rows repeat their sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charterloom.functions.batches import by_bytes

# Scores of what a span closes with.
HARD, MARK, QUOTED, ELLIPSIS, COLON, BLANK_LINE, WIDE_SPACE, SHORT_LINE = 12.0, 4.0, 5.0, -0.5, 0.5, 12.0, 9.0, 3.0
ABBREVIATED, MAY_CLOSE, CUT_SHORT = -8.0, -4.5, -3.0
# Scores of what a span opens with.
CAPITAL, SMALL, OPENER, BULLET, GOES_ON_SMALL = 2.0, -1.0, 1.0, 9.0, -9.0
# For each end of a span that lies within a quotation.
UNBALANCED = -8.0
# Joint terms.
ONE_WORD, TWO_WORDS, BARE_NUMBER, WRAPPED, NOT_ALONE = -2.0, -1.0, -8.0, -9.0, -12.0
#: Characters that a span may have at no cost, and characters that cost a point beyond.
FREE_LENGTH, LENGTH_STEP = 600, 400.0
#: A span of so many characters has more than two words, or they are long ones.
FEW_WORDS = 40

#: Abbreviations that rarely end a sentence.
ABBREVIATIONS = frozenset("""
art bzw ca cal cap cf ch chap cod den dni dns dr ebd eccl ed eds env epist esp evtl ex fig fl fo fol frz geb gest ggf hl hll hrsg ibid
idib inkl jh jhd jr kal kap kartular lib lic m mag mgr mme mlle mr mrs ms mss nr no non op p par pf pp prep prof rev s scil sect sen
sogen sol sr st ste sub sup tab tit u usf vgl vol vols vs z zzgl add abb anm bd bde bl eccles episc id kgl nob rel sel str
им св гл др стр рис ул гг вв тыс руб проф акад см ср напр π χ δηλ βλ κ κα κλπ αρ σελ
""".split()) - {"no"}  # fmt: skip
#: Abbreviations that may also end a sentence.
CLOSING_ABBREVIATIONS = frozenset("etc usw ff г т.д т.п".split())
#: Abbreviations only before a number.
BEFORE_NUMBERS = frozenset("no nos art ch ex fig add lib cap vol p pp f ff l s z c sp col n nr".split())
#: Words with which a numbered date goes on.
AFTER_ORDINALS = frozenset("""
jh jhd jahrhundert jahrhunderts januar februar märz april mai juni juli august september oktober november dezember
tag tage monat woche kapitel band
""".split())
#: Words that open sentences and clauses.
OPENERS = frozenset("""
ad ante aqua at autem contra coram cum de dictus ego et ex hanc hec hic in inter ita item ne nos notum omnis per post preterea pro quia qui
quod sciant si sub ut unde universis
a an also after all and as at before but by each every for from he however i if in it know of on she that the then there they this to
under we when while without with you
ab als am an auch auf aus bei da das dem den der des die doch ein eine er es für ich im in ist mit nach nun oder ohne sie so über um und unter
von vor wegen wenn wer wie wir zu zum zur
à après au aussi avant avec ce cette chaque comme dans de depuis des devant donc elle en entre et il ils je la le les lorsque mais nous on
ou où par pour puis quand que qui sans selon si sous sur tous un une
""".split())
#: Words that a sentence rarely ends with.
NO_CLOSERS = frozenset("""
et ac atque vel de in ad apud per pro sub cum ex ab inter post sine contra coram quod quia ut si quam ego nos neque
and or the a an of to from at by with without for that if then we i which in on each
und oder der die das dem den des ein eine einen einem einer von vor zu zum zur bei mit nach ohne wegen daß dass wenn so ich wir im in
keinen keine kein le la les un une du des au aux ou que qui de à en dans par pour avec sans sur sous je nous si chaque
""".split())
#: Words that go on after quoted speech in scripts without case.
GOES_ON = ("而", "と", "って", "라고", "하고", "고")

_HARD = frozenset("。！？｡।॥۔؟።፧։‼⁇⁈⁉！？။៕።᙮᠃᠉꓿꘎꛳⸮")
_SOFT = ".!?…‥．;:" + chr(0x37E)
_GREEK_QUESTION = ";" + chr(0x37E)
_MARKS = re.escape("".join(sorted(_HARD)) + _SOFT)
_MARKS_SET = frozenset("".join(_HARD) + ".!?…‥．")
_QUOTES = {"«": "»", "‹": "›", "„": "“”", "‚": "‘’", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉", "“": "”", "‘": "’"}
_SELF = "\"'"
_CLOSERS = frozenset("".join(_QUOTES.values()))
_REVERSED = {"»": "«", "›": "‹"}
_BRACKETS = frozenset("([（【")
_QUOTE = re.compile("[" + re.escape("".join({*_QUOTES, *_CLOSERS, *_SELF})) + r"]|\n\s*\n")
_EDGE = " \t\r\n\v\f\x1c\x1d\x1e\x1f\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
_GAP = re.compile(f"[{_EDGE}]*")
#: Blocks of scripts that write no sentence mark: Thai and Lao.
_NO_MARKS = chr(0x0E00) + "-" + chr(0x0EFF)
_CANDIDATE = re.compile(f"[{_MARKS}]+|[^\\S\n]*\n[{_EDGE}]*|(?<=[{_NO_MARKS}])[ \xa0]+(?=[{_NO_MARKS}])")
_BULLET = re.compile(r"(?:[-*•‣▪◦–—·]|\d{1,3}[.)]|\(?[a-zA-Z0-9]{1,2}\)|\(\d{1,3}\))[ \t\xa0]+\S|§\s*\d+\s*(?:\n|$)")
_ARMENIAN = frozenset(map(chr, range(0x531, 0x589)))
_COMBINING = frozenset(chr(c) for a, b in ((0x300, 0x36F), (0x591, 0x5C7), (0x900, 0x963)) for c in range(a, b + 1))
_COMBINING |= {c for c in map(chr, range(0x964, 0xE00)) if unicodedata.category(c) in ("Mn", "Mc")}  # vowel signs of the other Indic scripts
_IN_WORD = _COMBINING | set("_'" + chr(0x2019) + chr(0x5F3))
#: Words of Devanagari that are shortened with a period where sentences may close with one too.
INDIC_ABBREVIATIONS = frozenset("डॉ डा श्री सौ प्रो पं कु रु ता इ उदा क्र पृ सं स्व".split())
_NEXT_WORD = re.compile(r"\S+")
_FIRST = re.compile(r"[\w]+")
_ROMAN = re.compile(r"[IVXLCDM]+$|[ivxlcdm]+$")
_NARROW = frozenset(" \xa0" + chr(0x2009) + chr(0x202F))
_OPENING = "\"'«„“‹‘‚‚»›(「『[（《〈¿¡—–-•*·"
_OPENING_SET = frozenset(_OPENING)
_UP_TO_WORD = re.compile("[" + re.escape(_OPENING) + _EDGE + "]*")
_UP_TO_LETTER = re.compile("[" + re.escape(_OPENING) + _EDGE + "0-9]*")

_UPPER, _LOWER, _DIGIT, _PLAIN, _END = range(5)


def pair_quotes(text: str) -> dict[int, int]:
    """Position of each closing quote or bracket to that of its opening one; pairs do not cross blank lines.

    A closing mark takes the last opening one that waits for it, however deep.
    """
    pairs: dict[int, int] = {}
    stack: list[int] = []
    waiting: dict[str, list[int]] = {}
    n = len(text)
    for m in _QUOTE.finditer(text):
        ch, at = m[0], m.start()
        if len(ch) > 1 or ch == "\n":
            stack.clear()
            waiting.clear()
            continue
        before, after = text[at - 1] if at else " ", text[at + 1] if at + 1 < n else " "
        if ch in "'’‘" and before.isalnum() and after.isalnum():
            continue
        places = waiting.get(ch)
        if places and (ch not in _SELF or not before.isspace() or after.isspace() or not after.isalnum()):
            k = places[-1]
            pairs[at] = stack[k]
            del stack[k:]
            for others in waiting.values():
                while others and others[-1] >= k:
                    others.pop()
            continue
        if ch in _SELF:
            closers = ch if not before.isalnum() and not (after.isspace() and not before.isspace()) else ""
        elif ch in _QUOTES:
            closers = _QUOTES[ch]
        else:
            closers = _REVERSED[ch] if ch in _REVERSED and (before.isspace() or before in "(:") and not after.isspace() else ""
        if closers:
            for c in closers:
                waiting.setdefault(c, []).append(len(stack))
            stack.append(at)
    return pairs


def _outer(pairs: dict[int, int]) -> list[tuple[int, int]]:
    """Outermost pairs (open, close) in order."""
    out: list[tuple[int, int]] = []
    for close, opening in sorted(pairs.items(), key=lambda p: (p[1], -p[0])):
        if not out or opening > out[-1][1]:
            out.append((opening, close))
    return out


def _next_class(text: str, at: int) -> tuple[int, str]:
    """Kind of the first letter or digit from ``at`` on, past opening marks, and its word."""
    k = _UP_TO_WORD.match(text, at).end()
    if k >= len(text):
        return _END, ""
    ch = text[k]
    m = _FIRST.match(text, k)
    word = m[0] if m else ch
    if "\u10d0" <= ch <= "\u10ff":
        return _PLAIN, word  # Georgian writes without case, though its letters count as lower case
    if ch.isupper() or ch.istitle():
        return _UPPER, word
    if ch.islower():
        return _LOWER, word
    if ch.isdigit():
        return _DIGIT, word
    return _PLAIN, word


class Candidates:
    """Boundaries at which a span may end and the next one start, with the features of their scores."""

    def __init__(self, text: str, begin: int, end: int) -> None:
        self.text, self.begin, self.end = text, begin, end
        self.stops: list[int] = []
        self.starts: list[int] = [begin]
        self.closing: list[float] = []
        self.opening: list[float] = [0.0]
        #: Opening mark that the closed span should begin with, or -1.
        self.alone: list[int] = []
        #: A line that only a list item ends with.
        self.wrapped: list[bool] = []
        #: A period after a number.
        self.numbered: list[bool] = []
        self.dandas = "\u0964" in text or "\u0965" in text
        self.width = max(map(len, text.split("\n"))) if "\n" in text else 0
        self._find()

    def bullet(self, k: int) -> bool:
        """Does the span that starts at candidate ``k`` open with a list bullet?"""
        return _BULLET.match(self.text, self.starts[k]) is not None

    def add(self, stop: int, start: int, closing: float, opening: float, alone: int = -1, wrapped: bool = False, numbered: bool = False) -> None:
        self.stops.append(stop)
        self.starts.append(start)
        self.closing.append(closing)
        self.opening.append(opening)
        self.alone.append(alone)
        self.wrapped.append(wrapped)
        self.numbered.append(numbered)

    def _find(self) -> None:
        text, begin, end = self.text, self.begin, self.end
        pairs = pair_quotes(text)
        outer = _outer(pairs)
        inside, n_outer, last = 0, len(outer), begin
        for m in _CANDIDATE.finditer(text, begin, end):
            at = m.start()
            if at < last:
                continue
            ch = text[at]
            closed = -1
            if mark := ch in _HARD or ch in _SOFT:
                stop = m.end()
                while stop < end:  # what closes after the mark belongs to it
                    if stop in pairs:
                        closed, stop = pairs[stop], stop + 1
                    elif text[stop] in _NARROW and stop + 1 in pairs and text[stop + 1] not in _QUOTES and (text[stop + 1] not in _SELF or stop + 2 >= end or text[stop + 2] in _EDGE):
                        closed, stop = pairs[stop + 1], stop + 2
                    elif closed >= 0 and text[stop] in _MARKS_SET:
                        stop += 1
                    else:
                        break
                start = _GAP.match(text, stop).end()
                if start >= end:
                    break
                features = self._mark(at, m[0], stop, start, closed)
                if features is None:
                    continue
                last = start
                if "\n" in text[stop:start]:
                    by_line = self._line(stop, start)
                    if by_line[0] + by_line[1] + (WRAPPED if by_line[-1] is True else 0.0) > features[0] + features[1]:
                        features = by_line
            else:
                stop, start = at, m.end()
                if "\n" in m[0]:
                    while stop > last and text[stop - 1] in _EDGE:  # a byte order mark before the break
                        stop -= 1
                    features = self._line(stop, start)
                else:
                    features = WIDE_SPACE, 0.0
                if start >= end or stop <= begin:
                    continue
            while inside < n_outer and outer[inside][1] < stop:
                inside += 1
            if inside < n_outer and outer[inside][0] < stop:
                features = features[0] + UNBALANCED, features[1] + UNBALANCED, *features[2:]
            self.add(stop, start, *features)

    def _line(self, stop: int, start: int) -> tuple:
        """Features of a line break without a final mark before it."""
        text = self.text
        if text.count("\n", stop, start) > 1:
            return BLANK_LINE, 0.0
        if "\u0e00" <= text[stop - 1] <= "\u0eff":
            return WIDE_SPACE, 0.0
        if _BULLET.match(text, start):
            return 0.0, BULLET
        line = text[text.rfind("\n", 0, stop) + 1 : stop].strip(_EDGE)
        m = _NEXT_WORD.match(text, start)
        fits = len(line) + 1 + (len(m[0]) if m else 0) <= max(self.width, 45)
        heading = fits and len(line) < 60 and line[-1:] not in ",:;،、，："
        return SHORT_LINE, GOES_ON_SMALL if text[start].islower() else 0.0, -1, not heading

    def _mark(self, at: int, mark: str, stop: int, start: int, closed: int) -> tuple | None:
        """Features of a sentence mark, or None for a mark within a word or number and for marks of other kinds."""
        text, begin = self.text, self.begin
        before = text[at - 1] if at > begin else " "
        kind, word = _next_class(text, start)
        hard = any(c in _HARD for c in mark)
        if closed >= 0:
            return self._after_quote(closed, start, kind)
        touching = start == stop
        follower = text[stop]
        if "．" in mark:
            if before.isdigit() and follower.isdigit():
                return None
            hard = hard or not (before.isascii() or kind in (_UPPER, _LOWER))
        if hard:
            return HARD, 0.0
        opening = CAPITAL if kind == _UPPER else SMALL if kind == _LOWER else 0.0
        if mark[0] in _GREEK_QUESTION:
            k = at - 1
            while k > begin and text[k] in _EDGE:
                k -= 1
            if not ("\u0370" <= text[k] <= "\u03ff" or "\u1f00" <= text[k] <= "\u1fff") or mark.strip(_GREEK_QUESTION) or touching and kind == _LOWER:
                return None
            return MARK, opening
        if mark[0] == ":":  # also written for the Armenian full stop
            return (COLON, opening) if mark == ":" and before in _ARMENIAN and not touching else None
        if touching:
            if kind == _LOWER or kind == _DIGIT or not (follower.isalpha() or follower in _OPENING_SET):
                return None
            if follower in "-–—'*·•":
                return None
        if kind in (_UPPER, _LOWER) and word.lower() in OPENERS:
            opening += OPENER
        stem = at
        while stem > begin and text[stem - 1] in _EDGE:
            stem -= 1
        own_at = stem
        while own_at > begin and ((c := text[own_at - 1]).isalnum() or c in _IN_WORD):
            own_at -= 1
        own = text[own_at:stem]
        low = own.lower()
        closing = CUT_SHORT if low in NO_CLOSERS else 0.0
        if mark == ".":
            spaced = stem < at
            return MARK + closing + (self._word("" if spaced else own, low, own_at, kind, word, touching, spaced)), opening, -1, False, own.isdigit()
        if ("…" in mark or "‥" in mark or ".." in mark) and "!" not in mark and "?" not in mark:
            return ELLIPSIS + closing, opening
        return MARK + closing, opening

    def _word(self, own: str, low: str, own_at: int, kind: int, word: str, touching: bool, spaced: bool) -> float:
        """What the word before a single period says about closing there."""
        text, begin = self.text, self.begin
        if not own:
            return ABBREVIATED if own_at == begin or spaced and kind == _LOWER else 0.0
        if own.isdigit():
            return ABBREVIATED if kind == _LOWER or word.lower() in AFTER_ORDINALS else 0.0
        dotted = own_at > begin and text[own_at - 1] in ".·"
        if low in CLOSING_ABBREVIATIONS:
            return MAY_CLOSE
        if low in BEFORE_NUMBERS and kind == _DIGIT or low in ABBREVIATIONS:
            return ABBREVIATED
        if dotted and (_ROMAN.match(own) or len(own) <= 2) or touching and kind == _UPPER and len(own) <= 2:
            return ABBREVIATED  # a dotted numeral or a dotted abbreviation
        if len(own) == 1 and (own.isupper() or own.islower()):
            return ABBREVIATED  # an initial or a one-letter abbreviation
        if kind == _LOWER and (_ROMAN.match(own) and own.isupper() or own[:-1].isdigit()):
            return ABBREVIATED  # an ordinal or a leaf number such as 83v
        if "\u0900" <= own[-1] <= "\u0dff":
            if self.dandas or low in INDIC_ABBREVIATIONS or len(own) == 1:
                return ABBREVIATED  # a text that closes with a danda, an abbreviation or an initial
            k = own_at - 1
            while k >= begin and text[k] in _EDGE:
                k -= 1
            if sum(c.isalpha() for c in own) == 1 and (k < begin or text[k] in _MARKS_SET):
                return ABBREVIATED  # an initial with its vowel sign, before which nothing of a sentence stands
        return 0.0

    def _after_quote(self, opening: int, start: int, kind: int) -> tuple:
        """Features after a quotation or bracket that holds a final mark at its end."""
        text, begin = self.text, self.begin
        if text[opening] in _BRACKETS:
            return QUOTED, GOES_ON_SMALL if kind == _LOWER else 0.0, opening
        if kind == _LOWER or text.startswith(GOES_ON, start):
            return QUOTED, GOES_ON_SMALL
        k = opening - 1
        while k >= begin and text[k] in _EDGE:
            k -= 1
        introduced = k >= begin and text[k] in ":：,،、，"
        return QUOTED, 0.0, -1 if introduced or kind != _PLAIN else opening


def joint_score(c: Candidates, i: int, j: int) -> float:
    """What the span from candidate ``i`` to the end at candidate ``j`` costs as a whole; never positive."""
    text, start, stop = c.text, c.starts[i], c.stops[j] if j < len(c.stops) else c.end
    size = stop - start
    score = 0.0
    if size < FEW_WORDS:
        spaces = text.count(" ", start, stop)
        score = ONE_WORD if not spaces else TWO_WORDS if spaces == 1 else 0.0
    elif size > FREE_LENGTH:
        score = (FREE_LENGTH - size) / LENGTH_STEP
    if j < len(c.stops):
        if c.numbered[j] and not any(map(str.isalpha, text[start:stop])):
            score += BARE_NUMBER
        if c.wrapped[j] and not c.bullet(i):
            score += WRAPPED
        if (opening := c.alone[j]) > start and text[start:opening].strip(_OPENING + _EDGE + "0123456789"):
            score += NOT_ALONE
    return score


def joint_gains(c: Candidates) -> list[float]:
    """For each start, how much a joint term may favour it over an earlier start for the same end; 0 for most."""
    gains = [0.0] * len(c.starts)
    lines, alone = any(c.wrapped), {p for p in c.alone if p >= 0}
    if not lines and not alone:
        return gains
    for k, start in enumerate(c.starts):
        if lines and c.bullet(k):
            gains[k] -= WRAPPED
        if alone:
            upto = _UP_TO_LETTER.match(c.text, start).end()
            if any(p in alone for p in range(start, upto + 1)):
                gains[k] -= NOT_ALONE
    return gains


def best_spans(c: Candidates) -> list[tuple[int, int]]:
    """The spans with the greatest total score."""
    starts, n, gains = c.starts, len(c.stops), joint_gains(c)
    active: list[int] = []  # starts that may still be the best for some end
    totals: list[float] = []  # best total of all that ends before an active start, with its opening
    reach: list[float] = []  # greatest total up to an active start
    back, best, lead = [], 0.0, float("-inf")
    for j in range(n + 1):
        total, at = best + c.opening[j], starts[j] / LENGTH_STEP
        if total + gains[j] > lead - at or not active:
            active.append(j)
            totals.append(total)
            reach.append(max(total, reach[-1]) if reach else total)
        # else an earlier start beats this one for every end, even by the cost of its greater length
        lead = max(lead, total + at)
        stop = c.stops[j] if j < n else c.end
        k = len(active) - 1
        by = active[k]
        top = totals[k] + joint_score(c, by, j)
        while k > 0:
            k -= 1
            i = active[k]
            bound, size = reach[k], stop - starts[i]
            if size > FREE_LENGTH:
                bound -= (size - FREE_LENGTH) / LENGTH_STEP
            if bound < top:
                break
            value = totals[k] + joint_score(c, i, j)
            if value >= top:
                top, by = value, i
        back.append(by)
        best = top + (c.closing[j] if j < n else 0.0)
    spans, j = [], n
    while True:
        i = back[j]
        spans.append((starts[i], c.stops[j] if j < n else c.end))
        if not i:
            return spans[::-1]
        j = i - 1


def segment(text: str | None) -> list[tuple[int, int]]:
    """Sentence spans of one text."""
    if not text:
        return []
    begin, end = _GAP.match(text).end(), len(text)
    while end > begin and text[end - 1] in _EDGE:
        end -= 1
    return best_spans(Candidates(text, begin, end)) if begin < end else []


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos) of every sentence.  A map over the scan; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches):
            rows, starts, stops = [], [], []
            for k, t in enumerate(part.column(1).to_pylist()):
                spans = segment(t)
                rows += [k] * len(spans)
                starts += [s for s, _ in spans]
                stops += [e for _, e in spans]
            keys = part.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=[key, "start_pos", "end_pos"])

    source = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, start_pos int, end_pos int")
