"""Stemming: the plural, -ed and -ing step as a Spark expression, and all of
Porter's algorithm (1980) as a pandas function.

A word is read as a pattern of C and V: a, e, i, o, u are V, and so is y after a
C; all other letters are C. The measure of a stem is how often V is followed by C.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import let


def pattern(word: Column) -> Column:
    """The word's C and V. Only runs of y need to be read letter by letter."""
    plain = F.translate(word, "aeioubcdfghjklmnpqrstvwxz", "VVVVV" + "C" * 20)
    plain = F.translate(F.regexp_replace(plain, "Cy", "CV"), "y", "C")
    vowel = lambda seen, ch: ch.isin(*"aeiou") | ((ch == "y") & F.endswith(seen, F.lit("C")))
    slow = F.aggregate(F.filter(F.split(word, ""), lambda ch: ch != ""), F.lit(""), lambda seen, ch: F.concat(seen, F.when(vowel(seen, ch), "V").otherwise("C")))
    return F.when(F.contains(word, F.lit("yy")), slow).otherwise(plain)


def _cut(word: Column, n: int) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - n)


def _ends(word: Column, *endings: str) -> Column:
    found = F.endswith(word, F.lit(endings[0]))
    for x in endings[1:]:
        found = found | F.endswith(word, F.lit(x))
    return found


def _measure(word: Column) -> Column:
    return F.regexp_count(pattern(word), F.lit("VC"))


def _repair(stem: Column) -> Column:
    """What is left of a word without -ed or -ing, given its e back or freed of a
    doubled consonant."""

    def by(p: Column) -> Column:
        last = F.right(stem, F.lit(1))
        doubled = (F.length(stem) > 1) & (last == F.substr(stem, F.length(stem) - 1, F.lit(1))) & _ends(p, "C")
        short = (F.regexp_count(p, F.lit("VC")) == 1) & _ends(p, "CVC") & ~last.isin("w", "x", "y")
        return (
            F.when(_ends(stem, "at", "bl", "iz"), F.concat(stem, F.lit("e")))
            .when(doubled, F.when(last.isin("l", "s", "z"), stem).otherwise(_cut(stem, 1)))
            .when(short, F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )

    return let(pattern(stem), by)


def stem(word: Column) -> Column:
    """A word of letters a to z without its plural, -ed or -ing; words of fewer
    than three letters stay."""
    singular = F.when(_ends(word, "sses"), _cut(word, 2)).when(_ends(word, "ies"), _cut(word, 2)).when(_ends(word, "s") & ~_ends(word, "ss"), _cut(word, 1)).otherwise(word)

    def rest(w: Column) -> Column:
        def loses(ending: str) -> Column:
            return _ends(w, ending) & F.contains(pattern(_cut(w, len(ending))), F.lit("V"))

        return (
            F.when(_ends(w, "eed"), F.when(_measure(_cut(w, 3)) > 0, _cut(w, 1)).otherwise(w))
            .when(loses("ed"), _repair(_cut(w, 2)))
            .when(loses("ing"), _repair(_cut(w, 3)))
            .otherwise(w)
        )

    # most words have none of the endings, and are done with here
    return F.when((F.length(word) < 3) | ~_ends(word, "s", "ed", "ing"), word).otherwise(let(singular, rest))


# Fixed values of Porter's algorithm: endings and what they become, tried in order.
SECOND = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    out = ""
    for ch in word:
        out += "V" if ch in "aeiou" or ch == "y" and out.endswith("C") else "C"
    return out


def measure(word: str) -> int:
    return shape(word).count("VC")


def _short_end(word: str) -> bool:
    return shape(word).endswith("CVC") and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word).endswith("C")


def step_one(w: str) -> str:
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) else w
    for ending in ("ed", "ing"):
        left = w.removesuffix(ending)
        if left != w and "V" in shape(left):
            if left.endswith(("at", "bl", "iz")):
                return left + "e"
            if _double_end(left):
                return left if left[-1] in "lsz" else left[:-1]
            return left + "e" if measure(left) == 1 and _short_end(left) else left
    return w


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Porter's stem of a word in lower case; up to two letters stay."""
    if len(word) < 3:
        return word
    w = step_one(word)
    if w.endswith("y") and "V" in shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (SECOND, THIRD):
        hit = next(((a, b) for a, b in table if w.endswith(a)), None) if len(w) > 1 else None
        if hit and measure(w[: -len(hit[0])]):
            w = w[: -len(hit[0])] + hit[1]
    hit = next((x for x in FOURTH if w.endswith(x)), None) if len(w) > 1 else None
    if hit:
        left = w[: -len(hit)] + (hit[0] if hit in ("sion", "tion") else "")
        if measure(left) > 1:
            w = left
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("l") and _double_end(w) and measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def porter_stem(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else porter(w))
