"""Words of a text as a full-text index keeps them: folded, without diacritics, stemmed (Porter 1980)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The suffixes of the published algorithm, in its order.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
REWRITES = tuple((dict(t), tuple(e for e, _ in t)) for t in (STEP2, STEP3))
LETTERS = bytes(ord("v" if chr(i) in "aeiou" else "c") for i in range(256))
LONGEST = 64
WORD = re.compile(r"[^\W_]+")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    if "y" not in word and word.isascii():
        return word.encode().translate(LETTERS).decode()
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, endings: tuple[str, ...]):
    if not word.endswith(endings):
        return None
    fits = [e for e in endings if word.endswith(e)]
    return max(fits, key=len)


@lru_cache(1 << 16)
def stem(w: str) -> str:
    """The stem of a lower-case word; very short and very long ones stay."""
    if not 3 <= len(w) <= LONGEST:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table, endings in REWRITES:
        end = _longest(w, endings)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = _longest(w, STEP4)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def words(text: str | None) -> list[str]:
    """Stemmed words of a text, in order; none for null."""
    if not text:
        return []
    plain = text.lower()
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c))
    return [stem(w) for w in WORD.findall(plain)]


@F.pandas_udf(ArrayType(StringType()))
def stemmed(texts: pd.Series) -> pd.Series:
    return texts.map(words)
