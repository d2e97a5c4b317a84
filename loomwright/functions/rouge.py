"""ROUGE-L F1 with Porter stemming, as a pandas UDF."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiou"


def _is_consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and _is_consonant(w, i - 1))


def _measure(stem: str) -> int:
    """Number of vowel-consonant runs."""
    shape = "".join("c" if _is_consonant(stem, i) else "v" for i in range(len(stem)))
    return len(re.findall("v+c+", shape))


def _has_vowel(stem: str) -> bool:
    return any(not _is_consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _is_consonant(w, n - 1) and not _is_consonant(w, n - 2) and _is_consonant(w, n - 3) and w[-1] not in "wxy"


# The suffix tables of Porter's public algorithm.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous",
    "ive", "ize",
]


def _swap(w: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else w
    return w


@functools.lru_cache(maxsize=1 << 16)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
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
    w = _swap(_swap(w, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def words(text: str, stemmed: bool = True) -> list[str]:
    """Lower-case runs of a-z and 0-9; those over three characters are stemmed."""
    found = re.findall(r"[a-z0-9]+", (text or "").lower())
    return [stem(w) if stemmed and len(w) > 3 else w for w in found]


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel: a word of work for each word of b."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def rouge_l_score(reference: str, hypothesis: str, stemmed: bool = True) -> float:
    """F1 of the longest common subsequence; 0 if either text has no words."""
    a, b = words(reference, stemmed), words(hypothesis, stemmed)
    common = lcs_length(a, b) if a and b else 0
    return 2 * common / (len(a) + len(b)) if common else 0.0


def rouge_l(reference: Column, hypothesis: Column, stemmed: bool = True) -> Column:
    """ROUGE-L F1 of two text columns."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([rouge_l_score(x, y, stemmed) for x, y in zip(a, b, strict=True)], dtype=float)

    return score(reference, hypothesis)
