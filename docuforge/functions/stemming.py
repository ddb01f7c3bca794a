"""Porter's stemming algorithm (M. F. Porter, 1980) and accent-free tokens, as an Arrow function.

Written from the published paper: words are measured by their vowel-consonant
sequences, and five steps of suffix rules apply, the longest matching suffix first.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix rules of steps 2 to 4 of the paper.
_STEP2 = "ational-ate tional-tion enci-ence anci-ance izer-ize abli-able alli-al entli-ent eli-e ousli-ous ization-ize ation-ate ator-ate alism-al iveness-ive fulness-ful ousness-ous aliti-al iviti-ive biliti-ble"
_STEP3 = "icate-ic ative- alize-al iciti-ic ical-ic ful- ness-"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _shape(word: str) -> str:
    """The word as c and v: y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word).endswith("c")


def _replace(word: str, rules: str) -> str:
    for rule in sorted(rules.split(), key=lambda r: -len(r.split("-")[0])):
        suffix, new = rule.split("-")
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    # 1a: plurals.
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + new
            break
    # 1b: past tense and gerund.
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (m := re.match("(.*)(?:ed|ing)$", word)) and "v" in _shape(m[1]):
        word = m[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    # 1c
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2), _STEP3)
    # 4: suffixes that go after a longer stem.
    for suffix in sorted(_STEP4.split(), key=lambda s: -len(s)):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    # 5: a final e, and a double l.
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def index_tokens(text: str | None) -> list[str]:
    """Stemmed tokens: runs of letters and digits in lower case without accents."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return [stem(t) for t in re.findall(r"[^\W_]+", plain)]


def stemmed(text: Column) -> Column:
    """``index_tokens`` of a column, an Arrow batch at a time: Spark has no stemmer of its own."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(index_tokens)

    return run(text)
