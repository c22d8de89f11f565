"""Text functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures of several letters, replaced in this order after lower-casing.
LIGATURES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ĳ", "ij"), ("ð", "dh"), ("þ", "th"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st"))
#: Historical letters with one counterpart.
SINGLE_LETTERS = {"ſ": "s", "ꝇ": "l", "ꝑ": "p", "ꝛ": "r", "ƿ": "w", "ᵹ": "g", "ꝺ": "d", "ꝼ": "f"}

_ASTRAL = r"[\x{10000}-\x{10FFFF}]"
_MOST_REPLACED = 400


def char_class(chars: str) -> str:
    """Body of a Java character class."""
    return "".join(rf"\x{{{ord(c):x}}}" for c in sorted(set(chars)))


def collapse_whitespace(text: Column) -> Column:
    """Every run of white space to one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def replace_in_order(text: Column, rules: dict[str, str] | tuple[tuple[str, str], ...]) -> Column:
    """Literal replacements, each on the result of the one before."""
    for source, target in rules.items() if isinstance(rules, dict) else rules:
        text = F.replace(text, F.lit(source), F.lit(target))
    return text


def fold_ligatures(text: Column) -> Column:
    """Lower case, then ligatures of several letters."""
    return replace_in_order(F.lower(text), LIGATURES)


def apply_alphabet(text: Column, alphabet: str, mapping: dict[str, str]) -> Column:
    """Letters of the alphabet stay, mapped characters are replaced at once, all others become blanks.

    Characters beyond the basic plane become two blanks, one for each of their
    code units.
    """
    letters = alphabet.replace(" ", "")
    text = F.regexp_replace(text, _ASTRAL, "  ")
    if set(mapping.values()) <= set(letters) and not set(mapping) & set(letters) and len(mapping) <= _MOST_REPLACED:
        # no target is a source: single replacements scan bytes, much faster than a lookup of every character
        return F.regexp_replace(replace_in_order(text, mapping), f"[^{char_class(letters + ' ')}]", " ")
    known = char_class(letters + "".join(mapping) + " ")
    text = F.regexp_replace(text, f"[^{known}]", " ")
    return F.translate(text, "".join(mapping), "".join(mapping.values())) if mapping else text


def reduce_phonetics(text: Column, alphabet: str, rules: dict[str, str]) -> Column:
    """Simultaneous single-letter rules; rules into letters outside the alphabet are dropped, an empty alphabet changes nothing."""
    letters = alphabet.replace(" ", "")
    if not letters:
        return text
    return apply_alphabet(text, letters, {s: t for s, t in rules.items() if t in letters})


def encoding_loss(text: Column, alphabet: str, mapping: dict[str, str]) -> Column:
    """Share of characters that :func:`apply_alphabet` changes; 0 for an empty text."""
    kept = F.length(text) - F.length(F.regexp_replace(text, f"[{char_class(alphabet.replace(' ', '') + ' ')}]", ""))
    return F.when(F.length(text) > 0, 1 - kept / F.length(text)).otherwise(F.when(text.isNotNull(), 0.0))


def alphabet_of(text: Column) -> Column:
    """Sorted distinct characters of a text."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def alnum_tokens(tokens: Column) -> Column:
    """Tokens of letters and digits only."""
    return F.filter(tokens, lambda t: t.rlike(r"^[\p{L}\p{N}]+$"))


def alnum_positions(tokens: Column) -> Column:
    """Positions of the tokens that :func:`alnum_tokens` keeps."""
    return F.filter(F.transform(tokens, lambda t, k: F.when(t.rlike(r"^[\p{L}\p{N}]+$"), k)), lambda k: k.isNotNull())


def common_prefix_length(a: Column, b: Column, most: int) -> Column:
    """Length of the common prefix, counted up to ``most``."""
    lengths = F.sequence(F.lit(1), F.lit(most))
    same = F.filter(lengths, lambda k: (F.length(a) >= k) & (F.length(b) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k)))
    return F.coalesce(F.array_max(same), F.lit(0))


def year_of(name: Column) -> Column:
    """First year 1000 to 2999 in a name that no digit touches, else 9999."""
    found = F.regexp_extract(name, r"(?<![0-9])([12][0-9]{3})(?![0-9])", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(9999))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Indel similarity 2 * LCS / (len a + len b), 1 for two empty strings.

    The longest common subsequence is one row of the usual table folded over
    the characters of ``b``.
    """
    left, right = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    zeros = F.array_repeat(F.lit(0), F.size(left) + 1)

    def step(row: Column, ch: Column) -> Column:
        def cell(out: Column, k: Column) -> Column:
            diagonal = F.element_at(row, k) + F.when(F.element_at(left, k) == ch, 1).otherwise(0)
            return F.concat(out, F.array(F.greatest(diagonal, F.element_at(row, k + 1), F.element_at(out, k))))

        return F.when(F.size(left) == 0, row).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(left), F.lit(1))), F.array(F.lit(0)), cell))

    lcs = F.element_at(F.aggregate(right, zeros, step), -1)
    total = F.size(left) + F.size(right)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs / total)
