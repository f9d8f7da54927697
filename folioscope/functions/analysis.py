"""Text analysis as column expressions: tokens, folding, white space; and Porter's stemmer.

Two analysers turn text into terms.  ``simple`` lower-cases and takes runs of letters and digits.
``porter`` also takes away diacritics and stems; the stemmer runs over distinct terms only.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The letters that fold to ASCII in queries, and the word patterns of the query box.
FOLD_FROM = "ıİşŞğĞüÜöÖçÇâÂîÎûÛ"
FOLD_TO = "iissgguuooccaaiiuu"
WORD_CHARS = "0-9A-Za-zÇĞİÖŞÜçğıöşüÂâÎîÛû"
WORD_PATTERN = f"[{WORD_CHARS}][{WORD_CHARS}'\\-]*"
ASCII_WORD_PATTERN = r"[0-9A-Za-z][0-9A-Za-z'\-]*"


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(x: Column | str) -> Column:
    """Words of the query box, letters of the supported languages included."""
    return F.regexp_extract_all(_column(x), F.lit(WORD_PATTERN), F.lit(0))


def ascii_words(x: Column | str) -> Column:
    return F.regexp_extract_all(_column(x), F.lit(ASCII_WORD_PATTERN), F.lit(0))


def fold(x: Column | str) -> Column:
    """Folded, lower-cased form under which spellings with and without diacritics meet."""
    return F.lower(F.translate(_column(x), FOLD_FROM, FOLD_TO))


def collapse(x: Column | str) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.btrim(F.regexp_replace(_column(x), r"(?U)\s+", " "))


#: White space of Unicode.
BLANKS = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def stripped_length(x: Column | str) -> Column:
    """Characters without white space at the ends."""
    return F.char_length(F.btrim(_column(x), F.lit(BLANKS)))


@lru_cache(1)
def _marks() -> tuple[str, str]:
    """Letters whose decomposition is an ASCII letter and marks, and those letters; by rule."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            pairs.append((chr(code), base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def unmark(x: Column | str) -> Column:
    """Takes diacritics away: composed letters by table, combining marks by class."""
    return F.regexp_replace(F.translate(_column(x), *_marks()), r"\p{Mn}+", "")


def simple_terms(x: Column | str) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_column(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def unmarked_terms(x: Column | str) -> Column:
    return F.regexp_extract_all(unmark(F.lower(_column(x))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


# ---- Porter's stemmer, after the paper of 1980 ----------------------------------------------------------

_VOWELS = frozenset("aeiou")


def _vowel(w: str, i: int) -> bool:
    if w[i] != "y":
        return w[i] in _VOWELS
    k = i  # of a run of y the letters are vowels and consonants in turn
    while k > 0 and w[k - 1] == "y":
        k -= 1
    return (k > 0 and w[k - 1] not in _VOWELS) == ((i - k) % 2 == 0)


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    n, before = 0, False
    for i, c in enumerate(stem):
        vowel = c in _VOWELS or (c == "y" and i > 0 and not before)
        n += before and not vowel
        before = vowel
    return n


def _has_vowel(stem: str) -> bool:
    """A y is one, but for the first letter: it follows a consonant, or else a vowel."""
    return not _VOWELS.isdisjoint(stem) or "y" in stem[1:]


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


# The suffix rules of the algorithm's steps 2 to 4.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> dict[str, list[tuple[str, str]]]:
    """Suffixes and what stands in their place, the longest first, by their last two letters."""
    out: dict[str, list[tuple[str, str]]] = {}
    for suffix, _, other in sorted((r.partition(":") for r in text.split(" ")), key=lambda r: -len(r[0])):
        out.setdefault(suffix[-2:], []).append((suffix, other))
    return out


_RULES2, _RULES3, _RULES4 = map(_rules, (_STEP2, _STEP3, _STEP4))


def _replace(w: str, rules: dict[str, list[tuple[str, str]]], least: int) -> str:
    for suffix, other in rules.get(w[-2:], ()):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem + other if _measure(stem) > least else w
    return w


def porter(w: str) -> str:
    """The stem of a lower-cased word; words of other scripts and of two letters stay."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w[-1] == "s":
        if w.endswith(("sses", "ies")):
            w = w[:-2]
        elif not w.endswith("ss"):
            w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, _RULES2, 0)
    w = _replace(w, _RULES3, 0)
    for suffix, _ in _RULES4.get(w[-2:], ()):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (n := _measure(w[:-1])) > 0 and (n > 1 or not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@lru_cache(200_000)
def stem(w: str) -> str:
    """``porter`` of the words met last; a Python worker keeps them from task to task."""
    return porter(w)


#: Analyser name -> expression for terms of a text, and the function that a query's words go through.
ANALYSERS: dict[str, tuple[Callable[[Column], Column], bool]] = {"simple": (simple_terms, False), "porter": (unmarked_terms, True)}


class Letters(dict):
    """For ``str.translate``: what an analyser makes of a single character; letters are entered as they are met."""

    def __init__(self, changed: dict[int, str], kept: list[tuple[int, int]]):
        super().__init__(changed)
        self.changed, self.kept = changed, kept

    def __missing__(self, c: int) -> str:
        i = bisect_right(self.kept, (c, 0x110000)) - 1
        self[c] = chr(c) if i >= 0 and c <= self.kept[i][1] else " "
        return self[c]

    def __reduce__(self):
        return Letters, (self.changed, self.kept)

    def terms(self, run: str) -> list[str]:
        return [t for t in run.translate(self).split(" ") if t]


#: Characters that are looked up at once; planes of Unicode that have letters or marks; and the one letter whose lower
#: case depends on its neighbours.
_BLOCK = 4_096
_PLANES = (range(0x80, 0xD800), range(0xE000, 0x40000), range(0xE0000, 0xE0200))
FINAL_FORM = "Σ"


@lru_cache(None)
def letters(analyser: str) -> Letters:
    """An analyser's expression as a table of characters beyond ASCII, read off from the expression itself.

    In both analysers each character but ``FINAL_FORM`` is treated alike wherever it stands, and A-Z, a-z and 0-9
    are the terms' characters within ASCII.
    """
    spark, terms = SparkSession.active(), ANALYSERS[analyser][0]
    blocks = [(r[i], "\n".join(f"a{chr(c)}a" for c in r[i : i + _BLOCK])) for r in _PLANES for i in range(0, len(r), _BLOCK)]
    made = F.array_join(F.transform(F.split("x", "\n"), lambda x: F.concat_ws(" ", terms(x))), "\n")
    changed: dict[int, str] = {}
    kept = [(ord("0"), ord("9")), (ord("a"), ord("z"))]
    for first, found in sorted(spark.createDataFrame(blocks, "first int, x string").select("first", made).collect()):
        for c, own in enumerate(found.split("\n"), first):
            if own[1:-1] == chr(c):
                joined = kept[-1][1] == c - 1
                kept[-1:] = [(kept[-1][0], c)] if joined else [kept[-1], (c, c)]
            elif own[1:-1] != " ":
                changed[c] = own[1:-1]
    return Letters(changed, kept)


def python_terms(text: str, analyser: str = "simple") -> list[str]:
    """The same terms on the driver, for the few words of a query."""
    import regex

    low = text.lower()
    if ANALYSERS[analyser][1]:
        table = dict(zip(map(ord, _marks()[0]), _marks()[1], strict=True))
        low = regex.sub(r"\p{Mn}+", "", low.translate(table))
    found = regex.findall(r"[\p{L}\p{N}]+", low)
    return [porter(w) for w in found] if ANALYSERS[analyser][1] else found


# ---- light stems for topic names ------------------------------------------------------------------------

# Suffixes of the light stemmer, and words that say nothing about a topic.
LIGHT_SUFFIXES = ("iness", "ments", "ment", "ings", "ing", "ied", "ed", "ly")
GENERIC = "joint joints hand hands tool tools wood woods work works make makes made using use used design style type types part parts new best good great simple easy basic".split()


def light_stem(x: Column) -> Column:
    """Folds plural and common endings of a lower-cased word, as an expression."""
    n = F.char_length(x)
    cut = lambda c, k: F.substring(c, F.lit(1), F.char_length(c) - k)
    plural = (
        F.when((n >= 4) & x.endswith("ies"), F.concat(cut(x, 3), F.lit("y")))
        .when((n >= 6) & x.rlike("(ch|sh|x|z)es$"), cut(x, 2))
        .when((n >= 5) & x.rlike("(?<![sui])s$"), cut(x, 1))
        .otherwise(x)
    )
    out = plural
    for suffix in reversed(LIGHT_SUFFIXES):
        out = F.when((F.char_length(plural) >= 4 + len(suffix)) & plural.endswith(suffix), cut(plural, len(suffix))).otherwise(out)
    return out


def light_stems(name: Column) -> Column:
    """Distinct light stems of a topic's words that are long and telling enough."""
    long = F.filter(F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0)), lambda w: F.char_length(w) >= 4)
    stems = F.array_distinct(F.transform(long, light_stem))
    return F.filter(stems, lambda s: (F.char_length(s) >= 4) & ~s.isin(GENERIC))


