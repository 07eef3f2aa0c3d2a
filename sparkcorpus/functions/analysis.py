"""Text analysis for full-text search: lexemes of documents and queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Danish stop words of the published Snowball list.
STOP_WORDS = frozenset(
    "og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over da fra du ud sin dem os op man hans hvor eller hvad skal selv her alle vil blev kunne ind når være dog noget ville jo deres efter ned skulle denne end dette mit også under have dig anden hende mine alt meget sit sine vor mod disse hvis din nogle hos blive mange ad bliver hendes været thi jer sådan".split()
)
# Suffixes of the published Danish stemming algorithm.
MAIN_SUFFIXES = "erendes erende hedens erede ethed heden endes erets heder ernes erens eren ered ende erne eres eret erer enes heds ene ere hed ens ers ets en er es et e".split()
_VOWELS = frozenset("aeiouyæøå")
_S_ENDINGS = frozenset("abcdfghjklmnoprtvyzå")


def _region(word: str) -> int:
    """Start of the part that may be cut: behind the first non-vowel that follows a vowel, from the third letter on."""
    for k in range(1, len(word)):
        if word[k] not in _VOWELS and word[k - 1] in _VOWELS:
            return max(k + 1, 3)
    return len(word)


def stem_danish(word: str) -> str:
    """Stem of a lower-case word by the published Danish algorithm."""
    start = _region(word)
    tail = lambda w: w[start:]
    for suffix in MAIN_SUFFIXES:
        if tail(word).endswith(suffix):
            word = word[: -len(suffix)]
            break
    else:
        if tail(word).endswith("s") and len(word) > 1 and word[-2] in _S_ENDINGS:
            word = word[:-1]
    undoubled = lambda w: w[:-1] if tail(w).endswith(("gd", "dt", "gt", "kt")) else w
    word = undoubled(word)
    if word.endswith("igst"):
        word = word[:-2]
    if tail(word).endswith("løst"):
        word = word[:-1]
    else:
        for suffix in ("elig", "els", "lig", "ig"):
            if tail(word).endswith(suffix):
                word = undoubled(word[: -len(suffix)])
                break
    if len(tail(word)) >= 2 and word[-1] == word[-2] and word[-1] not in _VOWELS:
        word = word[:-1]
    return word


def simple_lexemes(text: Column) -> Column:
    """Runs of letters and digits in lower case, in order; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(lists: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def stem(word: str) -> str:
        if word not in known:
            known[word] = stem_danish(word)
        return known[word]

    return lists.map(lambda words: [stem(w) for w in words if w not in STOP_WORDS])


def danish_lexemes(text: Column) -> Column:
    """``simple_lexemes`` without stop words, stemmed."""
    return _stemmed(simple_lexemes(text))


ANALYSERS = {"simple": simple_lexemes, "danish": danish_lexemes}
