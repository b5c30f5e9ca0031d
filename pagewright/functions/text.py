"""Analyzers: terms of a text as built-in column expressions, and Porter stems.

``surface`` terms are casefolded runs of letters and digits.  Casefolding is lower
case plus the characters where the two differ, taken from Python's own rule; texts
without any of them (nearly all) take the short path.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_ALL = [chr(o) for o in range(0x80, sys.maxunicode + 1) if not 0xD800 <= o < 0xE000]
#: Characters whose casefold isn't their lower case (built from the rule).
FOLDS = {c: c.casefold() for c in _ALL if c.casefold() != c.lower()} | {c: c.casefold() for c in "ß"}
#: All of these but sharp s and the sigmas, which the short path folds itself.
RARE = "".join(c for c in FOLDS if c not in "ßẞςΣ")
WORD = r"([\p{L}\p{N}]+)"


def _quick(text: Column) -> Column:
    """Casefold of text without rare characters: letters stay letters, so it can go before the cutting."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ς", "σ")


def fold(text: Column) -> Column:
    """Casefold, character by character; a sigma folds to the plain small one wherever it stands."""
    table = F.create_map(*(F.lit(x) for pair in {**FOLDS, "Σ": "σ", "ς": "σ"}.items() for x in pair))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lower(c))), "")


def _has_rare(text: Column) -> Column:
    """By one table lookup a character; a character class of this size would be tried member by member."""
    return F.length(F.translate(text, RARE, "")) != F.length(text)


def _cut(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


def terms(text: Column) -> Column:
    """Array of surface terms in order; null for null, empty for text without any."""
    slow = F.transform(_cut(text), lambda w: F.when(_has_rare(w), fold(w)).otherwise(_quick(w)))
    return F.when(_has_rare(text), slow).otherwise(_cut(_quick(text)))


def terms_sql(text: str) -> str:
    """The same in the oracle's dialect."""
    chain = "x"
    for c, f in {**FOLDS, "Σ": "σ"}.items():
        chain = f"replace({chain}, '{c}', '{f}')" if c in "ßΣςſµﬁﬂﬀﬃﬄﬅﬆẞ" else chain
    return f"list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+'), lambda x: replace(lower({chain}), 'ς', 'σ'))"


# --- Porter's algorithm (1980), with the extensions of its widely used implementation ---

#: Words with their own stems.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffix rules of steps 2, 3 and 4.
STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,bli ble,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble,fulli ful"
STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_RULES2 = [tuple(r.split(" ")) for r in STEP2.split(",")]
_RULES3 = [tuple(r.split(" ")) for r in STEP3.split(",")]
_RULES4 = STEP4.split()


def _shape(word: str) -> str:
    """``c`` for consonants and ``v`` for vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", _shape(stem))))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    s = _shape(word)
    return (s[-3:] == "cvc" and word[-1] not in "wxy") or (len(word) == 2 and s == "vc")


def _first(word: str, rules: list[tuple[str, str]], least: int) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _measure(stem) > least - 1 else word
    return word


def _step1(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    else:
        for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if word.endswith(suffix):
                word = word[: len(word) - len(suffix)] + new
                break
    if word.endswith("ied"):
        word = word[:-3] + ("ie" if len(word) == 4 else "i")
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: len(word) - len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                word = stem
                if stem.endswith(("at", "bl", "iz")):
                    word = stem + "e"
                elif _double(stem):
                    word = stem if stem[-1] in "lsz" else stem[:-1]
                elif _measure(stem) == 1 and _short(stem):
                    word = stem + "e"
                break
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    return word


def _step2(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _step2(word[:-2])
    if word.endswith("logi") and not any(word.endswith(s) for s, _ in _RULES2):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _first(word, _RULES2, 1)


def _step4(word: str) -> str:
    for suffix in _RULES4:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                return stem
            return word
    return word


def _step5(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(1 << 18)
def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    return _step5(_step4(_first(_step2(_step1(word)), _RULES3, 1)))


def tokenize(text: str) -> list[str]:
    """Casefolded, stemmed terms of a plain text."""
    return [stem(t.casefold()) for t in re.findall(r"[^\W_]+", text)]


def surface(text: str) -> list[str]:
    """Surface terms of one text, as :func:`terms` has them; for the few texts of queries, whose plans it keeps short."""
    return [t.casefold() for t in re.findall(r"[^\W_]+", text)]


@F.pandas_udf(ArrayType(StringType()))
def surface_column(texts: pd.Series) -> pd.Series:
    return texts.map(surface, na_action="ignore")


@F.pandas_udf(StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def tokenize_column(texts: pd.Series) -> pd.Series:
    return texts.map(tokenize, na_action="ignore")
