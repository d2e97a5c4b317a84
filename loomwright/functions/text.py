"""Column expressions over prompt text: segments, tokens, guards, budgets, overlaps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Instruction-bearing patterns whose segments are always kept.
GUARD_PATTERNS = [
    r"\bmust\b",
    r"\bexactly\b",
    r"\bonly\b",
    r"\bdo not\b",
    r"\bdon't\b",
    r"\breturn\b",
    r"\bformat\b",
    r"\bjson\b",
    r"\bxml\b",
    r"\bstep by step\b",
]

# A token that contains one of these is never trimmed.
PROTECTED_TOKEN_PARTS = ["not", "n't", "no", "never", "must", "should", "return", "format", "json", "xml"]

#: Ratios above this are clamped to it.
MAX_RATIO = 0.90


# White space, which also parts tokens: ASCII, control and Unicode spaces.
_SPACE = "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The same as a character class of patterns.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(c, F.lit(_SPACE))


def is_blank(c: Column) -> Column:
    """Null or white space only."""
    return strip(F.coalesce(c, F.lit(""))) == ""


def tokens(c: Column) -> Column:
    """White-space tokens; an empty text has none."""
    body = strip(F.coalesce(c, F.lit("")))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE + "+"))


def token_count(c: Column) -> Column:
    """Number of white-space tokens."""
    return F.size(tokens(c))


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def segments(c: Column) -> Column:
    """Sentences; if that gives one part only, paragraphs; if that does too, the whole text. Blank: none."""

    def paragraphs(whole: Column) -> Column:
        return bind(_parts(whole, rf"\n{SPACE}*\n"), lambda p: F.when(F.size(p) > 1, p).otherwise(F.array(whole)))

    def sentences(whole: Column) -> Column:
        return bind(_parts(whole, rf"(?<=[.!?]){SPACE}+"), lambda s: F.when(F.size(s) > 1, s).otherwise(paragraphs(whole)))

    none = F.array().cast("array<string>")
    return bind(strip(F.coalesce(c, F.lit(""))), lambda whole: F.when(whole == "", none).otherwise(sentences(whole)))


def is_guarded(c: Column, patterns: list[str] | None = None) -> Column:
    """Whether any guard pattern occurs, in any case."""
    return c.rlike("(?i)" + "|".join(patterns or GUARD_PATTERNS))


def is_protected_token(c: Column) -> Column:
    """Whether a token contains a protected part, in any case."""
    return F.lower(c).rlike("|".join(map(re.escape, PROTECTED_TOKEN_PARTS)))


def clamp_ratio(ratio: Column, default: float = 0.40) -> Column:
    """A null ratio takes the default; the rest is brought between 0 and MAX_RATIO."""
    return F.greatest(F.lit(0.0), F.least(F.coalesce(ratio.cast("double"), F.lit(default)), F.lit(MAX_RATIO)))


def target_tokens(original: Column, ratio: Column) -> Column:
    """Token budget: at least one; the product is cut, not rounded."""
    return F.greatest(F.lit(1), (original * (F.lit(1.0) - ratio)).cast("int"))


def token_reduction(original: Column, compressed: Column) -> Column:
    """Share of tokens saved; 0 if there were none, below 0 if tokens were added."""
    return F.when(original == 0, F.lit(0.0)).otherwise(1 - compressed.cast("double") / original)


def word_set(c: Column) -> Column:
    """Distinct lower-cased tokens."""
    return F.array_distinct(tokens(F.lower(c)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both.cast("double") / (F.size(a) + F.size(b) - both))


def preview(c: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(c, 1, n)


def mean_or_zero(c: Column) -> Column:
    """Mean as an aggregate; 0 for no rows."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def nearest_rank(values: Column, p: float) -> Column:
    """Of an array: the value at rank int(n * p) from 0, the last at most; 0 for an empty array."""
    at = F.least((F.size(values) * F.lit(float(p))).cast("int") + 1, F.size(values))
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.element_at(F.array_sort(values), at))
