"""Text analysers: how titles, bodies and tags become search terms.

``plain`` is a Spark expression (runs of ASCII letters and digits in lower case) that other engines
can restate. ``stemmed`` folds case and diacritics, takes runs of letters and digits of any script,
and stems English words by Porter's algorithm (Porter 1980), as an Arrow-batched UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9A-Za-z]+"), F.lit(0))
    return F.transform(found, F.lower)


def _consonants(w: str) -> list[bool]:
    """For each letter whether it is a consonant; a y is one unless it follows one."""
    out: list[bool] = []
    for c in w:
        out.append(c not in "aeiou" and (c != "y" or not out or not out[-1]))
    return out


def _measure(stem: str) -> int:
    forms = "".join("c" if x else "v" for x in _consonants(stem))
    return len(re.findall("v+c+", forms))


def _has_vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiou"


def _short_end(w: str) -> bool:
    return _consonants(w)[-3:] == [True, False, True] and w[-1] not in "wxy"


# The suffixes of steps 2, 3 and 4 of the published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _suffix(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(1 << 16)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if (w.endswith("sses") and len(w) > 4) or (w.endswith("ies") and len(w) > 3):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed") and len(w) > 3:
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _doubled(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        s = _suffix(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _suffix(w, STEP_4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def folded(text: str) -> str:
    """Lower case without combining marks."""
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFD", low)
        # A text has few different marks, each of which goes at once.
        for c in set(low):
            if unicodedata.combining(c):
                low = low.replace(c, "")
    return low


_WORD = re.compile(r"[^\W_]+")


def terms(text: str) -> list[str]:
    return [stem(w) for w in _WORD.findall(folded(text))]


def places(text: str, exact: frozenset[str], prefixes: tuple[str, ...]) -> tuple[int, dict[str, list[int]]]:
    """The number of ``terms`` of a text, and where those stand that are in ``exact`` or begin with one of ``prefixes``.

    A stem begins as its word does, so words with other first letters are counted only.
    """
    words = _WORD.findall(folded(text))
    first = {t[:1] for t in (*exact, *prefixes)}
    found: dict[str, list[int]] = {}
    for at in range(len(words)) if "" in first else [i for i, w in enumerate(words) if w[0] in first]:
        term = stem(words[at])
        if term in exact or term.startswith(prefixes):
            found.setdefault(term, []).append(at)
    return len(words), found


def stemmed(text: Column) -> Column:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: terms(x) if x else [])

    return F.pandas_udf(run, "array<string>")(text)


ANALYSERS = {"plain": plain, "stemmed": stemmed}


def query_terms(text: str, analyser: str) -> list[str]:
    """The terms of a query, analysed as the index is."""
    return terms(text) if analyser == "stemmed" else [x.lower() for x in re.findall("[0-9A-Za-z]+", text)]
